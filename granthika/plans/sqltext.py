"""Pieces of DuckDB SQL that several oracles share."""

SPACE = r"[\s\p{Z}\x{85}\x1C-\x1F]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def one_spaced(x: str) -> str:
    return strip(rf"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def clean_block(x: str) -> str:
    x = rf"regexp_replace(replace({x}, chr(160), ' '), '(?i)\[\s*/?\s*(?:TABLE|IMAGE)\s*\]', '', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g'), '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t\f\x0B]+', ' ', 'g'), ' *\n *', chr(10), 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^\s\p{{Z}}\x{{85}}\x1C-\x1F]+'))"


def host(x: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '')"


def spans(cut: str, behind: str, before: str = "") -> str:
    """Trimmed pieces of each document between cuts, with their offsets: a piece starts where the ones before it end."""
    piece = rf"string_split(regexp_replace(text, '{cut}', '{before}' || chr(1) || '{behind}', 'g'), chr(1))"
    return rf"""WITH p AS (SELECT doc_id, unnest({piece}) AS x, generate_subscripts({piece}, 1) AS i FROM documents WHERE text IS NOT NULL),
        o AS (SELECT doc_id, x, i, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS base FROM p),
        s AS (SELECT doc_id, i, {strip('x')} AS t, (base + length(x) - length(regexp_replace(x, '^{SPACE}+', '')))::BIGINT AS char_start FROM o)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS span_no, char_start, char_start + length(t) AS char_end, {words('t')} AS n_words FROM s WHERE t <> ''"""
