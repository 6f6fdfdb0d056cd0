"""SQL of the string kernels, for engines without them: Indel ratios by a bit-parallel reduction over characters, Soundex by translation.

The table fs has a row for each pair with n1, a1, n2, a2 and their token sets. A row of the subsequence table is a number of as
many bits as the shorter text has characters, in two halves of HALF bits each.
"""

from __future__ import annotations

HALF = 120
_SIDES = {"name": ("n1", "n2"), "addr": ("a1", "a2"), "comb": ("n1 || ' ' || a1", "n2 || ' ' || a2")}


def _tokens(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda x: x <> '')"


def _joined(tokens: str) -> str:
    return f"array_to_string(list_sort({tokens}), ' ')"


def soundex(word: str) -> str:
    coded = lambda x, more: f"translate({x}, 'bfpvcgjkqsxzdtlmnraeiouy{more}', '111122222222334556000000{'0' * len(more)}')"
    digits = f"{coded(f'lower({word}[1])', 'hw')} || {coded(f'''replace(replace(lower({word}[2:]), 'h', ''), 'w', '')''', '')}"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {word} = '' THEN '' ELSE substr(upper({word}[1]) || replace(substr({digits}, 2), '0', '') || '000', 1, 4) END"


def _ctes() -> str:
    kept = "s1_id, cand_id"
    texts = ", ".join(f"{a} AS {p}1, {b} AS {p}2" for p, (a, b) in _SIDES.items())
    sets = ", ".join(f"{_joined(_tokens(f'{p}{i}'))} AS {p}_s{i}, list_distinct({_tokens(f'{p}{i}')}) AS {p}_t{i}" for p in _SIDES for i in (1, 2))
    minus = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
    parts = ", ".join(f"{_joined(f'list_intersect({p}_t1, {p}_t2)')} AS {p}_both, {_joined(minus(f'{p}_t1', f'{p}_t2'))} AS {p}_left, {_joined(minus(f'{p}_t2', f'{p}_t1'))} AS {p}_right" for p in _SIDES)
    ones = ", ".join(f"trim({p}_both || ' ' || {p}_left) AS {p}_one, trim({p}_both || ' ' || {p}_right) AS {p}_two" for p in _SIDES)
    asked = [(f"{p}_s1", f"{p}_s2") for p in _SIDES] + [(f"{p}_one", f"{p}_two") for p in _SIDES] + [("name1", "name2")]
    sliding = " UNION ALL ".join(
        f"SELECT {kept}, '{p}' AS side, CASE WHEN length({p}1) <= length({p}2) THEN {p}1 ELSE {p}2 END AS short, CASE WHEN length({p}1) <= length({p}2) THEN {p}2 ELSE {p}1 END AS long FROM k1"
        f" UNION ALL SELECT {kept}, '{p}', {p}2, {p}1 FROM k1 WHERE length({p}1) = length({p}2)"
        for p in ("name", "addr")
    )
    ask = " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b FROM k4" for a, b in asked)
    limb = lambda low: f"coalesce(sum(CAST(1 AS HUGEINT) << greatest(0, least({HALF - 1}, i - {low + 1}))) FILTER (i > {low} AND i <= {low + HALF}), 0)"
    full = lambda low: f"(CAST(1 AS HUGEINT) << greatest(0, least({HALF}, length(x) - {low}))) - 1"
    top = f"(CAST(1 AS HUGEINT) << {HALF})"
    return f"""
k1 AS (SELECT {kept}, {texts} FROM fs), k2 AS (SELECT *, {sets} FROM k1), k3 AS (SELECT *, {parts} FROM k2), k4 AS (SELECT *, {ones} FROM k3),
sl AS ({sliding}),
wn AS (SELECT {kept}, side, short, substr(long, greatest(s, 0) + 1, least(s + length(short), length(long)) - greatest(s, 0)) AS part FROM (SELECT *, unnest(range(1 - length(short), length(long))) AS s FROM sl WHERE short <> '')),
rq AS (SELECT row_number() OVER () AS q, * FROM (SELECT DISTINCT CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM ({ask} UNION ALL SELECT short, part FROM wn))),
mk AS (SELECT q, x[i] AS c, {limb(0)} AS lo, {limb(HALF)} AS hi FROM (SELECT q, x, unnest(range(1, length(x) + 1)) AS i FROM rq) GROUP BY q, x[i]),
ym AS (SELECT q, list({{'lo': coalesce(mk.lo, 0), 'hi': coalesce(mk.hi, 0)}} ORDER BY i) AS masks FROM (SELECT q, i, y[i] AS c FROM (SELECT q, y, unnest(range(1, length(y) + 1)) AS i FROM rq)) LEFT JOIN mk USING (q, c) GROUP BY q),
lr AS (SELECT q, list_reduce(list_prepend({{'lo': {full(0)}, 'hi': {full(HALF)}}}, coalesce(masks, [])), lambda s, m: {{
    'lo': ((s.lo + (s.lo & m.lo)) % {top}) | (s.lo - (s.lo & m.lo)), 'hi': ((s.hi + (s.hi & m.hi) + ((s.lo + (s.lo & m.lo)) // {top})) % {top}) | (s.hi - (s.hi & m.hi))}}) AS s FROM rq LEFT JOIN ym USING (q)),
lc AS (SELECT x, y, CASE WHEN y = '' THEN 1.0 ELSE CAST(2 * (length(x) - bit_count(s.lo & ({full(0)})) - bit_count(s.hi & ({full(HALF)}))) AS DOUBLE) / (length(x) + length(y)) END AS r FROM lr JOIN rq USING (q)),
rt AS (SELECT x AS a, y AS b, r FROM lc UNION SELECT y, x, r FROM lc),
pt AS (SELECT {kept}, side, max(CASE WHEN contains(short, part) AND length(part) = length(short) THEN 1.0 ELSE r END) AS r FROM wn JOIN rt ON rt.a = short AND rt.b = part GROUP BY ALL),
kr AS (SELECT k4.{kept.replace(', ', ', k4.')}, {", ".join(_columns())} FROM k4
  {" ".join(f"LEFT JOIN rt AS {p}_rs ON {p}_rs.a = {p}_s1 AND {p}_rs.b = {p}_s2 LEFT JOIN rt AS {p}_ro ON {p}_ro.a = {p}_one AND {p}_ro.b = {p}_two" for p in _SIDES)}
  LEFT JOIN rt AS rn ON rn.a = name1 AND rn.b = name2
  {" ".join(f"LEFT JOIN pt AS {p}_pt ON {p}_pt.s1_id = k4.s1_id AND {p}_pt.cand_id = k4.cand_id AND {p}_pt.side = '{p}'" for p in ("name", "addr"))}),
fr AS (SELECT * FROM fs JOIN kr USING ({kept}))"""


def _columns() -> list[str]:
    out = []
    for p in _SIDES:
        # What both have in common is the beginning of either, so its subsequence is itself.
        part = lambda x: f"CAST(2 * length({p}_both) AS DOUBLE) / (length({p}_both) + length({x}))"  # noqa: B023, E731
        out.append(f"{p}_rs.r AS {p}_tsort")
        out.append(
            f"CASE WHEN len({p}_t1) = 0 OR len({p}_t2) = 0 THEN 0.0 WHEN {p}_both <> '' AND ({p}_left = '' OR {p}_right = '') THEN 1.0"
            f" WHEN {p}_both = '' THEN {p}_ro.r ELSE greatest({p}_ro.r, {part(f'{p}_one')}, {part(f'{p}_two')}) END AS {p}_tset"
        )
        if p != "comb":
            out.append(f"CASE WHEN {p}1 = '' OR {p}2 = '' THEN CASE WHEN {p}1 = {p}2 THEN 1.0 ELSE 0.0 END ELSE {p}_pt.r END AS {p}_partial")
    return [*out, "rn.r AS name_ratio"]


#: Tables up to fr: fs with the ratios of texts, sorted tokens, token sets and windows.
RATIO_TABLES = _ctes()
RATIOS = ("name_tsort", "name_tset", "name_partial", "name_ratio", "addr_tsort", "addr_tset", "addr_partial", "comb_tsort", "comb_tset")

_WORD = lambda i: f"regexp_extract(n{i}, '([a-zA-Z]+)', 1)"
_CODES = lambda i: f"list_distinct(list_transform(regexp_extract_all(n{i}, '[a-zA-Z]{{2,}}'), lambda w: {soundex('w')}))"
#: Tables up to fp: fs with Soundex codes of the first word (x1, x2) and of all words (y1, y2).
SOUND_TABLES = f"fp AS (SELECT *, {soundex('w1')} AS x1, {soundex('w2')} AS x2 FROM (SELECT *, {_WORD(1)} AS w1, {_WORD(2)} AS w2, {_CODES(1)} AS y1, {_CODES(2)} AS y2 FROM fs))"
