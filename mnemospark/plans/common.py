"""Pieces of SQL that several queries share."""

NOW = "2026-04-01 00:00:00"

ENTRIES = """
entries AS (
  SELECT DISTINCT id, kind, content, source, scope, project, valid_at, asserted_at, expires_at, importance, confidence,
    reinforcement, last_hit_at, file, coalesce(status, 'active') AS status,
    coalesce(array_to_string(merged_from, ','), '') AS merged_from
  FROM memories),
visible AS (SELECT * FROM entries WHERE status NOT IN ('shadow', 'merged', 'expired'))
"""


def terms(x: str) -> str:
    """Words outside Chinese script and Chinese bigrams of a text expression."""
    return (
        f"list_concat(regexp_extract_all(regexp_replace(lower({x}), '[\\x{{4E00}}-\\x{{9FFF}}]+', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+'), "
        f"flatten(list_transform(regexp_extract_all({x}, '[\\x{{4E00}}-\\x{{9FFF}}]+'), lambda r: "
        "list_transform(range(1, greatest(CAST(length(r) AS BIGINT), 2)), lambda i: substring(r, i, 2)))))"
    )
