"""Secret scans with Spark's own functions: fixed patterns, and entropy in sliding windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds; letters of the words in either case. {24,} and {16,} find the same
#: matches as + with shorter ones dropped, as a match takes the whole run.
_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_VALUE = 6
#: Candidates for entropy: runs of one of these characters, with a digit and a letter.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
CANDIDATE = "[A-Za-z0-9+/_=]{20,}"
WINDOW = 20
#: Least entropy of a window in bits a character, by class of the candidate.
HEX_BITS, MIXED_BITS = 3.05, 3.65
#: What is known not to be secret: words of examples, alphabets in order, and runs of digits with few letters.
ALLOW = ("(?i)example|sample|dummy|placeholder|changeme", "(?i)abcdefgh|01234567|qwertyui", "^[0-9]+[A-Za-z]{1,2}$", "^[A-Za-z]+[0-9]{1,4}$", "/.*/.*/")
#: The same for runs judged piece by piece: these words cut a run, and what is left of it is judged by itself; a piece is left out
#: if it is a plain word with a number, or if it has three slashes and nothing but such words and up to three characters between them.
ALLOW_CUT = "(?i)example|sample|dummy|placeholder|changeme|abcdefgh|01234567|qwertyui"
_SEGMENT = "([A-Za-z0-9_=+]{0,3}|([A-Z]?[a-z]+|[A-Z]+)([_=+]([A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[0-9]{0,4}|[0-9]{1,8})"
ALLOW_PIECE = ("^[0-9]+[A-Za-z]{1,2}$", "^[A-Za-z]+[0-9]{1,4}$", f"^{_SEGMENT}(/{_SEGMENT}){{3,}}$")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
#: count * log2(count) in millionths, so that sums are exact.
UNITS = [round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 1)]


def _most(bits: float) -> int:
    """The largest sum of UNITS over a window's character counts that has at least so many bits."""
    return int((math.log2(WINDOW) - bits) * WINDOW * 1e6)


#: Counts of characters in a window, PACKED of them in a number, with five bits each (WINDOW is below 32).
PACKED = 12
#: Elements that are summed one by one; longer arrays by chunks of so many. Characters of a block from which pieces of a text are cut.
CHUNK, BLOCK = 256, 4096


def _entropy_window(candidate: str) -> str:
    """SQL for struct(a, z): the flagged stretch of a candidate, 0-based, end exclusive; a is -1 without one.

    A window moves over the candidate, whose characters are taken apart once; the count of the character that enters and of the one
    that leaves change, and with them the sum of count * log2(count), so a step costs the same for any window and candidate.
    """
    units = "array(" + ",".join(map(str, UNITS)) + ")"
    count = lambda c: f"cast(shiftrightunsigned(acc.n[p.{c} div {PACKED}], cast(p.{c} % {PACKED} * 5 as int)) & 31 as int)"
    unit = lambda c: f"shiftleft(1L, cast(p.{c} % {PACKED} * 5 as int))"
    steps = f"""transform(array(transform(split({candidate}, ''), x -> instr('{ALPHABET}', x))), codes -> transform(codes, (x, i) ->
        struct(x as e, if(i >= {WINDOW}, codes[i - {WINDOW}], 0) as l)))[0]"""
    most = f"if(rlike({candidate}, '^[0-9a-fA-F]+$'), {_most(HEX_BITS)}, {_most(MIXED_BITS)})"
    flag = f"acc.i >= {WINDOW} and acc.s <= most"
    scan = f"""aggregate({steps},
        named_struct('n', array_repeat(0L, {len(ALPHABET) // PACKED + 1}), 's', 0, 'i', 0, 'a', -1, 'z', -1),
        (acc, p) -> named_struct(
            'n', if(p.e = p.l, acc.n, transform(acc.n, (c, k) -> c + if(k = p.e div {PACKED}, {unit("e")}, 0L) - if(p.l > 0 and k = p.l div {PACKED}, {unit("l")}, 0L))),
            's', if(p.e = p.l, acc.s, acc.s + {units}[{count("e")} + 1] - {units}[{count("e")}]
                + if(p.l > 0, {units}[{count("l")} - 1] - {units}[{count("l")}], 0)),
            'i', acc.i + 1,
            'a', if(acc.a < 0 and {flag}, acc.i - {WINDOW}, acc.a),
            'z', if({flag}, acc.i, acc.z)),
        acc -> named_struct('a', if(acc.a < 0 and {flag}, acc.i - {WINDOW}, acc.a), 'z', if({flag}, acc.i, acc.z)))"""
    return f"transform(array({most}), most -> {scan})[0]"


def _running(numbers: str, start: str, merge: str) -> str:
    """SQL for the array of merge (of a and b) over all elements of numbers before each, from start on.

    Chunks are merged one by one and then in themselves, so no array is built element by element and time stays in proportion.
    """
    fold = lambda of, first: f"aggregate({of}, {first}, (a, b) -> {merge})"
    return f"""transform(array(transform(sequence(0, (size({numbers}) - 1) div {CHUNK}), c -> slice({numbers}, cast(c * {CHUNK} + 1 as int), {CHUNK}))), parts ->
        transform(array(aggregate(parts, array({start}), (acc, p) -> concat(acc, array({fold("p", "element_at(acc, -1)")})))), befores ->
            flatten(transform(parts, (p, c) -> transform(p, (x, i) -> {fold("slice(p, 1, i)", "befores[c]")}))))[0])[0]"""


def _placed(found: str, between: str) -> str:
    """SQL for array(struct(start, end, text)) of matches, from them and the text between them."""
    steps = f"transform({found}, (m, i) -> length({between}[i]) + length(m))"
    return f"""transform(array({steps}), steps -> transform(array({_running("steps", "0", "a + b")}), before ->
        transform({found}, (m, i) -> named_struct('s', before[i] + length({between}[i]), 'z', before[i] + steps[i], 'm', m)))[0])[0]"""


def _inside(spans: str, x: str) -> str:
    """SQL: whether x lies in one of spans (struct(s, z)), which follow each other without overlap; found by halving."""
    last = f"aggregate(sequence(30, 0, -1), 0, (p, k) -> if(p + shiftleft(1L, k) <= size({spans}) and {spans}[cast(p + shiftleft(1L, k) - 1 as int)].s <= {x}.s, cast(p + shiftleft(1L, k) as int), p))"
    return f"(size({spans}) > 0 and transform(array({last}), p -> p > 0 and {x}.z <= {spans}[greatest(p, 1) - 1].z)[0])"


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "spans", by_piece: bool = False) -> DataFrame:
    """docs with out_col: array of struct(start, end, kind), by start, then kind as in KINDS.

    start and end are code points, the end exclusive. Kinds assign, access and hex are fixed patterns, all of
    which stay. entropy_hex and entropy_mixed are stretches of candidates in which a window of WINDOW characters has
    at least the class's entropy; those that ALLOW fits, or that lie inside a span of a fixed pattern, are left out.
    by_piece: ALLOW_CUT cuts candidates into pieces and ALLOW_PIECE leaves out pieces, in place of ALLOW; so a word or some
    slashes inside a long key don't hide the rest of it. Without it the spans are those of SQL.
    Null and empty texts have no spans. All columns of docs stay; a column named out_col is replaced.
    Working columns begin with two underscores and "secret".
    """
    t = "__secret_text"
    df = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    df = df.withColumns({f"__secret_{k}": F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    empty = "cast(array() as array<struct<s:int,z:int,m:string>>)"
    df = df.withColumns(
        {f"__secret_{k}_b": F.when(F.size(f"__secret_{k}") > 0, F.split(t, p, -1)) for k, p in patterns.items()}
        | {"__secret_v": F.when(F.size("__secret_assign") > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)))}
    )
    df = df.withColumns({f"__secret_{k}_p": F.expr(f"if(size(__secret_{k}) > 0, {_placed(f'__secret_{k}', f'__secret_{k}_b')}, {empty})") for k in patterns})
    base = [
        f"transform(filter(__secret_assign_p, (x, i) -> length(__secret_v[i]) >= {LEAST_VALUE}), x -> struct(x.s as s, 0 as k, x.z as z))",
        "transform(__secret_access_p, x -> struct(x.s as s, 1 as k, x.z as z))",
        "transform(__secret_hex_p, x -> struct(x.s as s, 2 as k, x.z as z))",
    ]
    allowed = " or ".join(f"rlike(x.m, '{p}')" for p in (ALLOW_PIECE if by_piece else ALLOW))
    if by_piece:
        parts = _placed(f"split(x.m, '{ALLOW_CUT}', -1)", f"concat(array(''), regexp_extract_all(x.m, '{ALLOW_CUT}', 0))")
        parts = f"transform({parts}, y -> named_struct('s', x.s + y.s, 'z', x.s + y.z, 'm', y.m))"
        pieces = f"flatten(transform(__secret_entropy_p, x -> if(rlike(x.m, '{ALLOW_CUT}'), {parts}, array(x))))"
        df = df.withColumn("__secret_entropy_p", F.expr(f"filter({pieces}, x -> length(x.m) >= {WINDOW})"))
    df = df.withColumns({f"__secret_in{k}": F.expr(b) for k, b in enumerate(base)})
    df = df.withColumn("__secret_base", F.expr("concat(__secret_in0, __secret_in1, __secret_in2)"))
    df = df.withColumn(
        "__secret_c",
        F.expr(
            f"""filter(__secret_entropy_p, x -> rlike(x.m, '[0-9]') and rlike(x.m, '[A-Za-z]') and not ({allowed})
            and not ({" or ".join(_inside(f"__secret_in{k}", "x") for k in range(3))}))"""
        ),
    )
    df = df.withColumn("__secret_w", F.expr(f"transform(__secret_c, x -> struct(x.s as s, x.m as m, {_entropy_window('x.m')} as w))"))
    more = """transform(filter(__secret_w, x -> x.w.a >= 0), x -> struct(x.s + x.w.a as s,
        if(rlike(x.m, '^[0-9a-fA-F]+$'), 3, 4) as k, x.s + x.w.z as z))"""
    df = df.withColumn("__secret_all", F.expr(f"array_sort(concat(__secret_base, {more}))"))
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    df = df.withColumn(out_col, F.expr(f"transform(__secret_all, x -> named_struct('start', x.s, 'end', x.z, 'kind', {names}[x.k]))"))
    return df.drop(*[c for c in df.columns if c.startswith("__secret_")])


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of find_secrets replaced by mask in text_col; overlapping spans share one mask.

    Candidates are judged by piece. Null texts stay null. All columns stay, those that no span touches with the same text.
    """
    found = find_secrets(docs, text_col, "__spans", by_piece=True)
    quoted = f"`{text_col}`"
    # of each span: the furthest end before it; it opens a new mask if it begins there or later
    found = found.withColumn("__upto", F.expr(f"if(size(__spans) > 0, transform(array(transform(__spans, x -> x.end)), ends -> {_running('ends', '0', 'greatest(a, b)')})[0], array())"))
    found = found.withColumn("__blocks", F.expr(f"if(size(__spans) > 0, transform(sequence(0, length({quoted}) div {BLOCK}), k -> substring({quoted}, cast(k * {BLOCK} + 1 as int), {BLOCK})), array())"))
    piece = lambda a, z: f"""array_join(transform(if({a} < {z}, sequence({a} div {BLOCK}, ({z} - 1) div {BLOCK}), array()), k ->
        substring(__blocks[cast(k as int)], cast(greatest({a} - k * {BLOCK}, 0) + 1 as int), cast(least({z} - k * {BLOCK}, {BLOCK}) - greatest({a} - k * {BLOCK}, 0) as int))), '')"""  # noqa: E731
    pieces = f"""concat(transform(__spans, (x, i) -> if(x.start >= __upto[i], concat({piece("__upto[i]", "x.start")}, '{mask}'), '')),
        transform(array(array_max(transform(__spans, x -> x.end))), e -> {piece("e", f"length({quoted})")}))"""
    text = F.when(F.size("__spans") > 0, F.expr(f"array_join({pieces}, '')")).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).drop("__spans", "__upto", "__blocks")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string))), ',')")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, their digest, and all spans as text."""
    out = find_secrets(docs.select("doc_id", "text"))
    count = {f"n_{k}": F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)") for k in KINDS[:3]}
    out = out.withColumn("base", F.expr("filter(spans, x -> x.kind in ('assign', 'access', 'hex'))"))
    return out.select("doc_id", *[c.alias(k) for k, c in count.items()], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _sql_placed(kind: str, pattern: str, rank: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS k, '{kind}' AS kind, s, s + length(m) AS z, m, v FROM (
      SELECT doc_id, m[i] AS m, v[i] AS v, coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
      FROM (SELECT doc_id, m, b, v, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS b,
          {f"regexp_extract_all(t, '{quoted}', 2)" if kind == "assign" else f"regexp_extract_all(t, '{quoted}')"} AS v FROM d)))"""


_UNIT_SQL = "[" + ",".join(map(str, UNITS)) + "]"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, k, kind, s, z FROM ({_sql_placed("assign", ASSIGN, 0)}) WHERE length(v) >= {LEAST_VALUE}
  UNION ALL SELECT doc_id, k, kind, s, z FROM ({_sql_placed("access", ACCESS, 1)})
  UNION ALL SELECT doc_id, k, kind, s, z FROM ({_sql_placed("hex", HEX, 2)})),
cand AS (SELECT c.doc_id, c.s, c.z, c.m FROM ({_sql_placed("c", CANDIDATE, 9)}) c
  WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({" OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOW)})
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s <= c.s AND c.z <= b.z)),
win AS (SELECT doc_id, s, m, j, sum({_UNIT_SQL}[n + 1]) AS units FROM (
    SELECT doc_id, s, m, j, ch, count(*) AS n FROM (
      SELECT doc_id, s, m, j, unnest(string_split(substr(m, j, {WINDOW}), '')) AS ch FROM (
        SELECT doc_id, s, m, unnest(range(1, length(m) - {WINDOW} + 2)) AS j FROM cand))
    GROUP BY ALL) GROUP BY doc_id, s, m, j),
extra AS (SELECT doc_id, CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN 3 ELSE 4 END AS k,
    CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN 'entropy_hex' ELSE 'entropy_mixed' END AS kind, s + min(j) - 1 AS s, s + max(j) - 1 + {WINDOW} AS z
  FROM win WHERE units <= CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {_most(HEX_BITS)} ELSE {_most(MIXED_BITS)} END GROUP BY doc_id, s, m),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
    coalesce(string_agg(kind || ':' || s || ':' || z, ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
    string_agg(kind || ':' || s || ':' || z, ',' ORDER BY s, k) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
