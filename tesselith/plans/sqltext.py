"""Pieces of the SQL equivalents."""

from __future__ import annotations

from tesselith.functions import patterns as P


def rx(column: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({column}, '{flags}{pattern.replace(chr(39), chr(39) * 2)}')"


def rep(column: str, pattern: str, by: str, flags: str = "") -> str:
    return f"regexp_replace({column}, '{flags}{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def squash(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def n_words(column: str) -> str:
    t = squash(f"coalesce({column}, '')")
    return f"CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END"


#: One row for each provision, with its group's key.
PASSAGES = f"p AS (SELECT DISTINCT ON (provision_id) *, {squash('lower(nation)')} AS grp FROM corpus)"


def rule_hits() -> str:
    """A list of the function labels that fire, in the order of priority."""
    parts = []
    for k in P.LABELS:
        hit = " OR ".join(rx("coalesce(text, '')", x) for x in P.RULES[k])
        if k in P.HEADING_RULES:
            hit += " OR " + rx("coalesce(heading, '')", P.HEADING_RULES[k])
        parts.append(f"CASE WHEN {hit} THEN '{k}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def modality() -> str:
    t = rep("coalesce(text, '')", P.DEFINING, " ", "(?i)")
    rest = rep(t, P.NEGATED, " §NEG§ ", "(?i)")
    got = f"concat_ws(',', CASE WHEN {rx(t, P.MUST_NOT)} THEN 'MUST_NOT' END, CASE WHEN {rx(rest, P.MAY)} THEN 'MAY' END, CASE WHEN {rx(rest, P.MUST)} THEN 'MUST' END)"
    return f"coalesce(nullif({got}, ''), 'NONE')"


def references() -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {rx(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')', x)} THEN '{k}' END" for k, x in P.REFERENCES.items()) + ")"


def mask_numbers(column: str) -> str:
    for pattern, mark, any_case in P.NUMBERS:
        column = rep(column, pattern, mark, "(?i)" if any_case else "")
    return squash(column)


def domain(*fields: str) -> str:
    t = f"concat_ws(' ', {', '.join(fields)})"
    crim, civ = rx(t, P.CRIMINAL), rx(rep(t, P.NOT_CIVIL, " ", "(?i)"), P.CIVIL)
    return f"CASE WHEN {civ} AND NOT {crim} THEN 'civil' WHEN {crim} AND NOT {civ} THEN 'criminal' END"


def order(seed: str, key: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {key}))"
