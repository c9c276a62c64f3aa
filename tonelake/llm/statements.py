"""The SQL that states the results of queries, for the check in DuckDB."""

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS words FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct([array_to_string(words[k:k + 4], ' ') FOR k IN range(1, len(words) - 3)]) END AS shingles
    FROM w
), tokens AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), together AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS common
    FROM tokens a JOIN tokens b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY ALL
), links AS (
    SELECT a, b FROM together WHERE 100 * common >= 80 * (n + m - common)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT DISTINCT a AS doc_id, a AS other FROM edges
    UNION
    SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a
), lowest AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN lowest USING (doc_id)
"""


def _estimated(rounds: int, rules: int) -> str:
    """The rounds of expectation-maximisation over ``pat(v0 .., n)``, one pair of tables each."""

    def posterior(s: str) -> str:
        terms = [f"ln({s}.share / (1 - {s}.share))"]
        terms += [
            f"CASE v{j} WHEN -1 THEN ln({s}.b{j} / {s}.g{j}) WHEN 1 THEN ln((1 - {s}.b{j}) / (1 - {s}.g{j})) ELSE 0.0 END"
            for j in range(rules)
        ]
        return f"1 / (1 + exp(-({' + '.join(terms)})))"

    starts = [f"CAST(0.4 AS DOUBLE) AS b{j}, CAST(0.02 AS DOUBLE) AS g{j}" for j in range(rules)]
    parts = [f"s0 AS MATERIALIZED (SELECT CAST(0.1 AS DOUBLE) AS share, {', '.join(starts)})"]
    for k in range(1, rounds + 1):
        parts.append(f"p{k} AS MATERIALIZED (SELECT pat.*, n * ({posterior('s')}) AS bad FROM pat, s{k - 1} s)")
        columns = ["greatest(0.01, least(0.5, (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 10.0))) AS share"]
        for j in range(rules):
            for name, weight, more, lo, hi in (("b", "bad", 4.0, 0.2, 0.95), ("g", "(n - bad)", 0.2, 0.001, 0.02)):
                against, either = (
                    f"coalesce(sum(CASE WHEN v{j} {c} THEN {weight} END), 0)" for c in ("= -1", "<> 0")
                )
                columns.append(f"greatest({lo}, least({hi}, ({against} + {more}) / ({either} + 10.0))) AS {name}{j}")
        parts.append(f"s{k} AS MATERIALIZED (SELECT {', '.join(columns)} FROM p{k})")
    return ", ".join(parts) + f", final AS (SELECT v.doc_id, 1 - {posterior('s')} AS p_good FROM voted v, s{rounds} s)"


def _vote(bad: str, good: str) -> str:
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


_VOTES = [
    _vote("n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
    _vote("n_symbols * 20 > word_chars", "n_symbols * 200 <= word_chars"),
    _vote("n_dup_lines * 10 > n_lines * 3", "n_lines > 1 AND n_dup_lines = 0"),
    _vote("n_repeat_words * 5 > n_words", "n_words >= 20 AND n_repeat_words * 20 <= n_words"),
    _vote("word_chars > n_words * 12 OR word_chars < n_words * 2", "word_chars BETWEEN n_words * 3 AND n_words * 9"),
    _vote("n_words >= 20 AND n_distinct * 8 < n_words", "n_words >= 20 AND n_distinct * 4 >= n_words"),
    _vote("n_upper * 3 > word_chars", "n_upper * 10 <= word_chars"),
    _vote("n_exclaim * 5 > n_words", "n_exclaim * 50 <= n_words"),
    _vote("n_words >= 20 AND n_ends * 100 < n_words", "n_words >= 20 AND n_ends * 50 >= n_words AND n_ends * 2 <= n_words"),
    _vote("n_words >= 20 AND n_function = 0", "n_function * 20 >= n_words"),
]

_FUNCTION_WORDS = "the of and to in a is that de la le les et en des der die und das den von el los que y una".split()

#: ``documents`` may be any relation (doc_id, text) with distinct ids.
QUALITY = f"""
WITH w AS MATERIALIZED (
    SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT doc_id, k, array_to_string(words[k:k + 4], ' ') AS win
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM w)
), again AS (
    SELECT doc_id, k FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), repeats AS (
    SELECT doc_id, count(DISTINCT k + j) AS n FROM again, range(5) t(j) GROUP BY doc_id
), counted AS MATERIALIZED (
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
        len(lines) AS n_lines, len(list_distinct(words)) AS n_distinct,
        len(list_filter(words, lambda x: x IN ({", ".join(repr(x) for x in _FUNCTION_WORDS)}))) AS n_function,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim,
        length(regexp_replace(text, '[^.?!]', '', 'g')) AS n_ends
    FROM w LEFT JOIN repeats USING (doc_id)
), voted AS MATERIALIZED (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        {", ".join(f"{v} AS v{j}" for j, v in enumerate(_VOTES))}
    FROM counted
), pat AS MATERIALIZED (
    SELECT {", ".join(f"v{j}" for j in range(10))}, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY ALL
), {_estimated(40, 10)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND p_good >= 0.5 AS kept
FROM voted JOIN final USING (doc_id)
"""


def _digest(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


_PRIMES = [8388593, 8388587, 8388581, 8388571, 8388547, 8388539, 8388473, 8388461]

MIX = f"""
WITH sizes AS MATERIALIZED (
    SELECT doc_id, source, CAST(sum(len({WORDS.format("coalesce(text, '')")})) AS BIGINT) AS size
    FROM documents GROUP BY doc_id, source
), per_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM sizes GROUP BY source
), weighed AS (
    SELECT *, CAST(1 + source_no % 3 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS lim FROM per_source
), levelled AS (
    SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM weighed)
        - coalesce(sum(lim) OVER (ORDER BY lim / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY lim / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
    FROM weighed
), sources AS MATERIALIZED (
    SELECT *, least(lim, weight * (SELECT lev FROM levelled WHERE lev <= lim / weight ORDER BY lim / weight, source_no LIMIT 1))
        AS target, CAST(ceil(source_size / 64) AS BIGINT) AS n_blocks,
        CASE WHEN source IS NULL THEN 'none' ELSE '=' || source END AS name
    FROM levelled
), slotted AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target * n_blocks / source_size + 0.5) AS BIGINT) ELSE 0 END AS slots
    FROM sources
), slots AS (
    SELECT source_no, n_blocks, name, slot, slot // n_blocks AS turn
    FROM (SELECT *, unnest(range(slots)) AS slot FROM slotted WHERE slots > 0)
), keyed AS (
    SELECT *, {_digest("'0|' || name || '|' || turn")} AS key,
        list_filter([{", ".join(map(str, _PRIMES))}], lambda p: n_blocks % p <> 0) AS fitting FROM slots
), draws AS (
    SELECT source_no, (fitting[1 + key % len(fitting)] * (slot - turn * n_blocks) + key % n_blocks) % n_blocks AS block,
        count(*) AS times FROM keyed GROUP BY ALL
), placed AS MATERIALIZED (
    SELECT z.*, s.source_no, s.source_size, s.target, coalesce(sum(size) OVER (PARTITION BY source_no
        ORDER BY {_digest("coalesce(CAST(doc_id AS VARCHAR), 'none')")}, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM sizes z JOIN sources s ON z.source IS NOT DISTINCT FROM s.source
), pieces AS (
    SELECT doc_id, source_no, block, least(start + size, (block + 1) * 64) - greatest(start, block * 64) AS n
    FROM (SELECT *, unnest(range(CAST(start // 64 AS BIGINT), CAST((start + size - 1) // 64 + 1 AS BIGINT))) AS block
        FROM placed WHERE size > 0)
), sums AS (
    SELECT doc_id, source_no, sum(n * times) AS taken FROM pieces JOIN draws USING (source_no, block) GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN sums s ON p.source_no = s.source_no AND p.doc_id IS NOT DISTINCT FROM s.doc_id
"""

LM_SCORES = f"""
WITH w AS MATERIALIZED (
    SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS words FROM documents
), t AS MATERIALIZED (
    SELECT doc_id, k, words[k] AS word, CASE WHEN k > 1 THEN words[k - 1] END AS before
    FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM w)
), ones AS MATERIALIZED (
    SELECT word, count(*) AS n FROM t GROUP BY word
), twos AS MATERIALIZED (
    SELECT before, word, count(*) AS n FROM t WHERE k > 1 GROUP BY ALL
), scored AS (
    SELECT t.doc_id, k, coalesce(twos.n, 0) >= 2 AS known,
        CASE WHEN coalesce(twos.n, 0) >= 2 THEN ln(twos.n) - ln(context.n)
            ELSE ln(ones.n) - ln((SELECT count(*) FROM t)) + CASE WHEN k > 1 THEN ln(0.4) ELSE 0 END END AS value
    FROM t JOIN ones ON t.word = ones.word LEFT JOIN ones context ON t.before = context.word
        LEFT JOIN twos ON t.before = twos.before AND t.word = twos.word
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(sum(CASE WHEN NOT known THEN 1 END), 0) AS BIGINT) AS n_backed,
    round(sum(value) / len(words), 6) AS score
FROM w LEFT JOIN scored USING (doc_id) GROUP BY w.doc_id, words
"""

HARD_NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [x::DOUBLE FOR x IN embedding] AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
), rows AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS owner, vec_id, label, [floor(256 * x) FOR x IN c] AS v
  FROM usable WHERE len(c) = (SELECT max(len(embedding)) FROM embeddings) AND len([1 FOR x IN c IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT a.owner, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.owner <> b.owner
), positives AS (
  SELECT owner, anchor_id, other_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY owner ORDER BY score DESC, other_id) AS place
  FROM scores WHERE same
), ranked AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.owner, p.place ORDER BY s.score DESC, s.other_id) AS rank
  FROM positives p JOIN scores s ON s.owner = p.owner AND NOT s.same
   AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
