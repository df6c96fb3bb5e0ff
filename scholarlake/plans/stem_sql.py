"""The stemmer in DuckDB's SQL: a chain of common table expressions over a table of tokens."""

from __future__ import annotations

from scholarlake.functions import stem as S

_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _longest(cases: dict[str, str], other: str = "w") -> str:
    return "CASE " + " ".join(f"WHEN suffix(w, '{s}') THEN {cases[s]}" for s in sorted(cases, key=len, reverse=True)) + f" ELSE {other} END"


def _inside(region: str, suffix: str, then: str) -> str:
    return f"CASE WHEN length(w) - {len(suffix)} >= {region} THEN {then} ELSE w END"


def _swap(rules: dict[str, str], region: str) -> dict[str, str]:
    return {s: _inside(region, s, f"{_cut(len(s))} || '{to}'") for s, to in rules.items()}


def stems_sql(tokens: str, name: str = "sm") -> str:
    """CTEs that end in `name` (token, stem), for a table expression with a column token."""
    ies = f"CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END"
    gone = lambda s: f"CASE WHEN regexp_matches({_cut(len(s))}, '[aeiouy]') THEN {_cut(len(s))} END"
    two = _swap(S.STEP_2, "r1") | {"ogi": _inside("r1", "ogi", f"CASE WHEN suffix(w, 'logi') THEN {_cut(1)} ELSE w END"), "li": _inside("r1", "li", f"CASE WHEN contains('{S.LI_ENDING}', right({_cut(2)}, 1)) THEN {_cut(2)} ELSE w END")}
    four = _swap(dict.fromkeys(S.STEP_4, ""), "r2") | {"ion": _inside("r2", "ion", f"CASE WHEN suffix(w, 'sion') OR suffix(w, 'tion') THEN {_cut(3)} ELSE w END")}
    known = " ".join(f"WHEN starts_with(w, '{p}') THEN {len(p)}" for p in S.R1_AFTER)
    stages = [
        r"SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS w FROM " + f"(SELECT DISTINCT token FROM {tokens})",
        f"SELECT *, CASE {known} WHEN regexp_matches(w, '{_REGION}') THEN length(regexp_extract(w, '{_REGION}')) ELSE length(w) END AS r1 FROM {{}}",
        f"SELECT *, CASE WHEN regexp_matches(w[r1 + 1 :], '{_REGION}') THEN r1 + length(regexp_extract(w[r1 + 1 :], '{_REGION}')) ELSE length(w) END AS r2 FROM {{}}",
        f"SELECT * REPLACE ({_longest({'sses': _cut(2), 'ied': ies, 'ies': ies, 'us': 'w', 'ss': 'w', 's': f'CASE WHEN regexp_matches({_cut(2)}, {chr(39)}[aeiouy]{chr(39)}) THEN {_cut(1)} ELSE w END'})} AS w) FROM {{}}",
        f"SELECT *, w IN {S.WHOLE_AFTER_PLURAL} AS as_is, {_longest({'eedly': 'NULL', 'eed': 'NULL', 'ingly': gone('ingly'), 'edly': gone('edly'), 'ing': gone('ing'), 'ed': gone('ed')}, 'NULL')} AS c FROM {{}}",
        f"""SELECT * REPLACE (CASE WHEN as_is THEN w WHEN c IS NULL THEN {_longest({'eed': _inside('r1', 'eed', _cut(1)), 'eedly': _inside('r1', 'eedly', _cut(3))})}
  WHEN regexp_matches(c, '(at|bl|iz)$') THEN c || 'e' WHEN right(c, 2) IN {S.DOUBLES} THEN left(c, length(c) - 1) WHEN r1 >= length(c) AND regexp_matches(c, '{S.SHORT}') THEN c || 'e' ELSE c END AS w) FROM {{}}""",
        f"SELECT * REPLACE (CASE WHEN regexp_matches(w, '.[^aeiouy][yY]$') AND NOT as_is THEN {_cut(1)} || 'i' ELSE w END AS w) FROM {{}}",
        f"SELECT * REPLACE (CASE WHEN as_is THEN w ELSE {_longest(two)} END AS w) FROM {{}}",
        f"SELECT * REPLACE (CASE WHEN as_is THEN w ELSE {_longest(_swap(S.STEP_3, 'r1') | {'ative': _inside('r2', 'ative', _cut(5))})} END AS w) FROM {{}}",
        f"SELECT * REPLACE (CASE WHEN as_is THEN w ELSE {_longest(four)} END AS w) FROM {{}}",
        f"SELECT * REPLACE (CASE WHEN as_is THEN w WHEN suffix(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches({_cut(1)}, '{S.SHORT}'))) OR suffix(w, 'll') AND length(w) - 1 >= r2 THEN {_cut(1)} ELSE w END AS w) FROM {{}}",
    ]
    out = []
    for i, stage in enumerate(stages):
        out.append(f"{name}_{i} AS ({stage.format(f'{name}_{i - 1}')})")
    whole = " ".join(f"WHEN '{w}' THEN '{to}'" for w, to in S.WHOLE.items())
    out.append(f"{name} AS (SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE CASE token {whole} ELSE replace(w, 'Y', 'y') END END AS stem FROM {name}_{len(stages) - 1})")
    return ",\n".join(out)
