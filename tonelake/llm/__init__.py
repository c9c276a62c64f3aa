"""Corpus operators over the text payloads of captures.

A decoded capture carries a message (``message_utf8``). Collected over many captures these
messages are a corpus, and the operators of this subpackage clean, score, mix and encode it.
Records are ``payloads(capture_id, message_utf8)``, ``captures(capture_id, modulation, ...)``
and the download manifest ``(name, url)``; only the columns that an operator names are read,
so further columns of any name do no harm and are not carried along.
"""
