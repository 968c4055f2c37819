"""Personal data: patterns propose spans, checks confirm them, nearby words adjust the score.

Only DataFrame functions.  A pattern's spans come from its matches and the gaps between
them (split and extract agree on the leftmost non-overlapping matches), so offsets are sums
of lengths in code points.  Base kinds keep every confirmed span whatever the context says;
the method's own kinds (``iban``, ``secret``) are kept from ``KEEP_SCORE`` on.

An account number is read at its country's length, so that a capitalised word, a code or another
number after it stays outside; the longest run is the reading where the country has none.

Patterns start with a look-ahead and refuse to start inside a run that the previous match
did not end (``\\G``): the matches are those of the plain pattern, in linear time on long runs.

Defined results: a null text is empty; spans of different kinds may overlap in ``spans``; in
masked text overlapping spans become one mask, named after the span that starts first (ties:
the earlier kind); repeated rows and extra columns, whatever their names, pass through unchanged; an
empty table gives no rows; time grows little faster than a text's length, however many spans it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm import textkit

KEEP_SCORE = 50
#: Code points before and after a span in which context words count.
NEAR = 40
#: Matches, or masks, that are placed together.
BLOCK = 256
#: Characters of an account number by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Z0-9])"
_REGISTERED = "|".join(c.replace(" ", "|") for c in IBAN_LENGTHS.values())
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: kind -> (pattern, score of a confirmed span, words that raise it, words that lower it)
KINDS: dict[str, tuple[str, int, str, str]] = {
    "email": (r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 80, "mail|contact|write", "example|noreply"),
    "ip": (r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", 60, "ip|host|server|address", "version|release"),
    "card": (r"[0-9](?:[ -]?[0-9])++", 80, "card|visa|credit|payment", "order|serial|tracking"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", 70, "phone|tel|call|mobile", "serial|isbn"),
    "iban": (rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN}|(?!{_REGISTERED})[A-Z]{{2}}[0-9]{{2}}(?: ?(?!{_IBAN})[A-Z0-9]){{11,30}}+)", 60, "iban|account|konto|bank|compte|cuenta", "serial|model|isbn"),
    "secret": (r"(?:token|secret|password|api_key) ?[=:] ?\"[A-Za-z0-9_./+-]{16,}+\"", 60, "auth|key|login", "example|dummy|placeholder"),
}
BASE = ("email", "ip", "card", "phone")
#: A text without this string has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "secret": '"'}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The checksum of payment card numbers over a string of digits."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """The checksum of account numbers: rotated by four, letters as 10 to 35, modulo 97 is 1."""
    flat = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))

    def step(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", total).when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The kind's own check of a match."""
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & mod97(match)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of one kind, in order of start.

    Matches are placed ``BLOCK`` at a time, so that no running list is copied for every match, and
    context is read from the block's own stretch of the text."""
    pattern, score, raising, lowering = KINDS[kind]
    shape = "array<struct<kind string, start int, end int, score int>>"
    spot = "array<struct<start int, size int>>"

    def found(matches: Column) -> Column:
        return _let(F.split(text, pattern, -1), lambda gaps: kept(matches, gaps))

    def kept(matches: Column, gaps: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
        return _let(pairs, lambda p: _let(F.transform(blocks_of(F.size(p)), lambda k: block(F.slice(p, k * BLOCK + 1, BLOCK))), placed))

    def block(pairs: Column) -> Column:
        """Confirmed spans from the block's begin on, and the block's length."""

        def step(state: Column, pair: Column) -> Column:
            start, size = state["at"] + pair["gap"], F.length(pair["match"])
            spans = F.when(confirmed(kind, pair["match"]), F.array_append(state["spans"], F.struct(start.alias("start"), size.alias("size")))).otherwise(state["spans"])
            return F.struct((start + size).alias("at"), spans.cast(spot).alias("spans"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(spot).alias("spans")), step)

    def placed(blocks: Column) -> Column:
        grown = F.aggregate(blocks, F.array(F.lit(0)), lambda begins, x: F.array_append(begins, F.element_at(begins, -1) + x["at"]))
        spans = F.flatten(_let(grown, lambda begins: F.transform(blocks, lambda x, k: F.when(F.size(x["spans"]) > 0, scored(x, F.get(begins, k))).otherwise(F.array().cast(shape)))))
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= KEEP_SCORE)

    def scored(x: Column, begin: Column) -> Column:
        low = F.greatest(begin - NEAR, F.lit(0))
        around = F.substring(text, low + 1, begin - low + x["at"] + NEAR)
        return _let(around, lambda near: F.transform(x["spans"], lambda s: one(near, begin - low + s["start"], s["size"], begin + s["start"])))

    def one(near: Column, at: Column, size: Column, start: Column) -> Column:
        left = F.substring(near, F.greatest(at - NEAR, F.lit(0)) + 1, F.least(at, F.lit(NEAR)))
        words = F.lower(F.concat(left, F.lit(" "), F.substring(near, at + size + 1, F.lit(NEAR))))
        total = _let(words, lambda w: F.lit(score) + F.when(w.rlike(raising), 20).otherwise(0) - F.when(w.rlike(lowering), 30).otherwise(0))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + size).alias("end"), total.alias("score"))

    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, found(m).cast(shape)).otherwise(F.array().cast(shape)))
    if kind in NEEDS:
        return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(shape))
    return spans


def blocks_of(size: Column) -> Column:
    """Numbers of the blocks that so many things fill; one at least."""
    return F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / BLOCK).cast("int"))


def all_spans() -> Column:
    """All spans of ``text`` by kind as listed in KINDS, then by start."""
    text = F.coalesce("text", F.lit(""))
    return F.concat(*[spans_of(k, text) for k in KINDS])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows = docs.select("doc_id", all_spans().alias("found"))
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    return rows.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, and n_chars anew."""
    columns = docs.columns
    (spans,) = textkit.fresh(docs, "spans")
    text = F.col("text")
    masks = "array<struct<before int, start int, kind string>>"

    def step(state: Column, s: Column) -> Column:
        """A span that begins within the ones before it joins their mask."""
        own = F.struct(state["reach"].alias("before"), s["start"].alias("start"), s["kind"].alias("kind"))
        out = F.when(s["start"] >= state["reach"], F.array_append(state["masks"], own)).otherwise(state["masks"])
        return F.struct(F.greatest(state["reach"], s["end"]).alias("reach"), out.cast(masks).alias("masks"))

    def block(state: Column, part: Column) -> Column:
        begin = F.struct(state["reach"].alias("reach"), F.array().cast(masks).alias("masks"))
        return _let(F.aggregate(part, begin, step), lambda x: F.struct(x["reach"].alias("reach"), F.array_append(state["masks"], x["masks"]).cast(f"array<{masks}>").alias("masks")))

    def clean(state: Column) -> Column:
        parts = F.filter(state["masks"], lambda x: F.size(x) > 0)
        return _let(parts, lambda p: F.concat(F.array_join(F.transform(p, stretch), ""), F.substring(text, state["reach"] + 1, F.length(text))))

    def stretch(part: Column) -> Column:
        """The text from the end of the mask before this block to its last mask, masked."""
        begin = F.element_at(part, 1)["before"]
        cut = lambda own: lambda m: F.concat(F.substring(own, m["before"] - begin + 1, m["start"] - m["before"]), F.lit("["), F.upper(m["kind"]), F.lit("]"))
        return _let(F.substring(text, begin + 1, F.element_at(part, -1)["start"] - begin), lambda own: F.array_join(F.transform(part, cut(own)), ""))

    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    by_start = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    parts = _let(by_start, lambda x: F.transform(blocks_of(F.size(x)), lambda k: F.slice(x, k * BLOCK + 1, BLOCK)))
    state = F.aggregate(parts, F.struct(F.lit(0).alias("reach"), F.array().cast(f"array<{masks}>").alias("masks")), block)
    fresh = F.when(F.size(F.col(spans)) > 0, _let(state, clean)).otherwise(text)
    out = docs.withColumn(spans, all_spans()).withColumn("text", fresh)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*textkit.quoted(columns))


def _oracle() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
        "secret": r'(?:token|secret|password|api_key) ?[=:] ?"[A-Za-z0-9_./+-]{16,}"',
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    flat = "replace(m, ' ', '')"
    check = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i, 1)::INT WHEN substr(reverse({digits}), i, 1)::INT > 4 THEN substr(reverse({digits}), i, 1)::INT * 2 - 9 ELSE substr(reverse({digits}), i, 1)::INT * 2 END for i in range(1, length({digits}) + 1)]) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({flat}) BETWEEN 15 AND 34 AND list_reduce([CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END for c in string_split(substr({flat}, 5) || left({flat}, 4), '')], lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END, 0) = 1",
        "secret": "true",
    }
    parts = []
    for k, (_, score, raising, lowering) in KINDS.items():
        near = f"lower(substr(text, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR}))) || ' ' || lower(substr(text, e + 1, {NEAR}))"
        ok = check[k] if k in BASE else f"{check[k]} AND {score} + CASE WHEN regexp_matches({near}, '{raising}') THEN 20 ELSE 0 END - CASE WHEN regexp_matches({near}, '{lowering}') THEN 30 ELSE 0 END >= {KEEP_SCORE}"
        parts.append(f"""SELECT doc_id, {list(KINDS).index(k)} AS rank, '{k}' AS kind, s, e FROM (
          SELECT *, s + length(m) AS e FROM (
            SELECT doc_id, text, ms[i] AS m, list_sum([length(x) for x in gs[1:i]])::BIGINT + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0)::BIGINT AS s FROM (
              SELECT doc_id, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{plain[k]}') AS ms, string_split_regex(coalesce(text, ''), '{plain[k]}') AS gs FROM documents))))
        WHERE {ok}""")
    named = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    item = "kind || ':' || s || ':' || e"
    return f"WITH f AS ({' UNION ALL '.join(parts)}) SELECT d.doc_id, {named}, sha256(coalesce(string_agg({item}, ',' ORDER BY rank, s) FILTER (rank < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({item}, ',' ORDER BY rank, s), '') AS spans FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"


ORACLE = _oracle()
