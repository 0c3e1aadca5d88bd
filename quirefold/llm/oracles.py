"""DuckDB SQL of the queries here that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quirefold.llm.license_texts import LICENSES, SPELLINGS
from quirefold.llm.licenses import COPYRIGHT, OTHER


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"' ' || trim(regexp_replace(lower(regexp_replace({column}, {_quoted(COPYRIGHT)}, '', 'g')), {_quoted(OTHER)}, ' ', 'g')) || ' '"
    for a, b in SPELLINGS.items():
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return f"trim({out})"


ORACLES: dict[str, str] = {
    "op6_license_lookup": f"""
        WITH known AS (
            SELECT {_canonical("t")} AS c, min(license_id) AS license_id
            FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in LICENSES.items())}) AS v(license_id, t) GROUP BY 1
        ), units AS (
            SELECT doc_id, true AS whole, {_canonical("text")} AS c FROM documents
            UNION ALL
            SELECT doc_id, false, {_canonical("line")} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
        )
        SELECT doc_id, license_id, bool_or(whole) AS whole, cast(sum(CASE WHEN whole THEN 0 ELSE 1 END) AS BIGINT) AS n_lines
        FROM units JOIN known ON sha256(units.c) = sha256(known.c) WHERE units.c <> '' GROUP BY doc_id, license_id
    """,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
