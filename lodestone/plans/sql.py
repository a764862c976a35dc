"""DuckDB expressions of the text rules, built from the same fixed values."""

from __future__ import annotations

from lodestone.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def count(t: str, needle: str) -> str:
    return f"CAST((length({t}) - length(replace({t}, {lit(needle)}, ''))) // {len(needle)} AS INTEGER)"


def hits(t: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({t}), {lit(n)}) AS INTEGER)" for n in needles) + ")"


def strip(t: str) -> str:
    return f"regexp_replace({t}, {lit(f'^[{T.WS}]+|[{T.WS}]+$')}, '', 'g')"


def sub(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, {lit(pattern)}, {lit(by)}, 'g')"


def collapse(t: str) -> str:
    return strip(sub(t, f"[{T.WS}]+", " "))


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, {lit(f'[{T.WS}]+')}), lambda w: w <> '')"


def matches(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {lit(pattern)}))"


def type_flags(t: str) -> dict[str, str]:
    add = lambda needles: "(" + " + ".join(count(t, n) for n in needles) + ")"
    sci = matches(t, T.SCIENTIFIC)
    out = {
        "is_math": f"({add(T.MATH)} > 5)",
        "is_code": f"({add(T.CODE)} > 3 OR contains({t}, '```'))",
        "is_physics": f"({add(T.PHYSICS)} + {sci} > 5 OR {sci} > 3)",
        "is_telemetry": f"({add(T.TELEMETRY)} + {matches(t, T.CLOCK)} + {count(t, ']')} // 10 > 5)",
    }
    return out | {"is_technical": "(" + " OR ".join(out.values()) + ")"}


def fix_unicode(t: str) -> str:
    for a, b in T.REPAIRS.items():
        t = f"replace({t}, {lit(a)}, {lit(b)})"
    return t


def contacts(t: str, phones: str = "false") -> str:
    out = sub(sub(t, T.URL, ""), T.EMAIL, "")
    return collapse(f"CASE WHEN {phones} THEN {sub(out, T.PHONE, '')} ELSE {out} END" if phones != "false" else out)


def language(t: str) -> str:
    w = words(f"lower(substr({t}, 1, {T.LANGUAGE_CHARS}))")
    n = ", ".join(f"len(list_filter({w}, lambda x: x IN ({', '.join(map(lit, s))})))" for s in T.STOP_WORDS.values())
    return f"list_extract([{', '.join(map(lit, T.STOP_WORDS))}], CAST(list_position([{n}], list_max([{n}])) AS INTEGER))"


def html(t: str) -> str:
    return collapse(sub(sub(t, T.TAG, " "), T.ENTITY, " "))


def pages(t: str, technical: str) -> str:
    light = strip(sub(sub(t, T.HYPHEN, r"\1\2"), r"\n{3,}", "\n\n"))
    full = t
    for pattern, by, multi in T.PAGE_RULES:
        full = sub(full, ("(?m)" if multi else "") + pattern, by.replace("$1$2", r"\1\2").replace(r"\$", "$"))
    return f"CASE WHEN {technical} THEN {light} ELSE {strip(full)} END"


def quality(t: str, technical: str) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    n, k = f"length({t})", hits(t, T.KEYWORDS)
    sentences = f"string_split({t}, '.')"
    capital = f"len(list_filter({sentences}, lambda s: regexp_matches(s, {lit(f'^[{T.WS}]*' + chr(92) + 'p{Lu}')})))"
    tone = (
        f"(CASE WHEN len({sentences}) > 2 AND {capital} / len({sentences}) > 0.7::DOUBLE THEN {d(0.05)} ELSE 0 END"
        f" + CASE WHEN {count(t, '.')} + {count(t, '!')} + {count(t, '?')} > 2 THEN {d(0.05)} ELSE 0 END"
        f" + CASE WHEN {hits(t, T.FORMAL)} >= 2 THEN {d(0.05)} ELSE 0 END"
        f" - CASE WHEN {hits(t, T.INFORMAL)} > 0 THEN {d(0.1)} ELSE 0 END"
        f" + CASE WHEN {technical} THEN {d(0.1)} ELSE 0 END)"
    )
    base = f"({d(0.5)} + CASE WHEN {n} BETWEEN 500 AND 5000 THEN {d(0.1)} ELSE 0 END + CASE WHEN {k} >= 3 THEN {d(0.2)} WHEN {k} >= 1 THEN {d(0.1)} ELSE 0 END)"
    return f"CASE WHEN {n} < {T.SHORT} OR {n} > {T.LONG} THEN {d(0)} ELSE least({d(1)}, greatest({d(0)}, {base} + {tone})) END"


def cosine(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
