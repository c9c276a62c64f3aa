"""SQL building blocks for the check of registered queries.

``sql("V", "a AS (...)", "SELECT ...")`` puts the named views in front of the steps.
"""

from __future__ import annotations

VIEWS = {
    "E": """E AS (
  SELECT vec_id AS capture_id, n::BIGINT AS n, embedding[2*n+1]::DOUBLE AS i, embedding[2*n+2]::DOUBLE AS q
  FROM embeddings, range(32) t(n))""",
    "E10": """E10 AS (
  SELECT label::BIGINT AS capture_id, (32*(rk-1)+n)::BIGINT AS n, embedding[2*n+1]::DOUBLE AS i, embedding[2*n+2]::DOUBLE AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rk FROM embeddings), range(32) t(n))""",
    "V": """V AS (
  SELECT event_type AS capture_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n,
         value AS i, 0.0::DOUBLE AS q
  FROM events)""",
    "TONE_SIGNS": """TONE_SIGNS AS (
  SELECT vec_id AS capture_id, k::BIGINT AS k, CASE WHEN embedding[k+1] > 0 THEN 1 ELSE -1 END AS s
  FROM embeddings, range(64) t(k))""",
    "TONE": """TONE AS (
  SELECT capture_id, (8*k+m)::BIGINT AS n, cos(0.3*(8*before + s*m)) AS i, sin(0.3*(8*before + s*m)) AS q
  FROM (SELECT *, coalesce(sum(s) OVER (PARTITION BY capture_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM TONE_SIGNS), range(8) t(m))""",
    "D": """D AS (
  SELECT doc_id AS capture_id, k::BIGINT AS k,
         (instr('0123456789ABCDEF', hx[1]) - 1) * 16 + instr('0123456789ABCDEF', hx[2]) - 1 AS b
  FROM (SELECT doc_id, unnest(h) AS hx, generate_subscripts(h, 1) - 1 AS k
        FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents)))""",
}

NEEDS = {"TONE": ["TONE_SIGNS"]}


def sql(views: str, *parts: str) -> str:
    """Statement made of named views, further steps, and a final SELECT."""
    names: list[str] = []
    for view in views.split():
        for name in [*NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    steps = [VIEWS[n] for n in names] + list(parts[:-1])
    head = "WITH " + ",\n".join(steps) + "\n" if steps else ""
    return head + parts[-1]


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    """Rounded DOUBLE without a signed zero, to match ``scalars.rounded``."""
    out = f"(round(({expr})::DOUBLE, {digits}) + 0.0)"
    return f"{out} AS {name}" if name else out
