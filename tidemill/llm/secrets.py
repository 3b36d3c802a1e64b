"""Secret scans that link the parts of a credential, with DataFrame functions only.

Strong kinds are reported wherever they are: ``assign``, ``access`` and ``hex``.
Weak candidates are identifiers, short or loosely named secrets and endpoints;
they are reported only near parts that complete them: an identifier near a
secret, a secret near an identifier, an endpoint near one of each that do. Parts that overlap
don't complete each other. Near means in the same scope, with no more than
``scope`` code points between the two: a scope is a block of lines without a blank
one, and the end of an object in braces that another follows ends it too. The join
by interval is a sorted pass over where each text's parts and scopes begin and end,
which looks at the nearest of each type on either side, so it makes no pairs.

Positions count code points and ends are exclusive. Null text counts as empty and
has no spans. Repeated rows are rows of their own, an empty table gives an empty
result, and other columns don't matter. Spans are worked through in blocks of ``BLOCK``
and cut from chunks of the text, so the work for a text grows with its length and
with the number of its spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.shared import scratch, written

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"(?i)(password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"  # of a run of these characters only its first AKIA counts, so the length can stand here
HEX = "[0-9a-f]{16,}"
IDENT = rf"(?i)(?<![A-Za-z0-9_])(user|username|user_?id|login|account|client_?id|access_?key|access_?key_?id){_VALUE}([A-Za-z0-9@+/_.-]{{3,}})"
WEAK = rf"(?i)(?<![A-Za-z0-9_])(pass|pwd|passphrase|key|credential|auth|private_?key|secret_?key){_VALUE}([A-Za-z0-9+/_.=-]{{6,}})"
ENDPOINT = rf"(?i)(?<![A-Za-z0-9_+])(?:[a-z][a-z0-9+]*://[A-Za-z0-9._~:/?@%&=+-]+|(?:host|hostname|endpoint|server){_VALUE}[A-Za-z0-9._:/-]{{3,}})"
BREAK = r"\n[\x20\t\r]*\n|\}[\x20\t\r\n]*+(?:,[\x20\t\r\n]*+)?\{"
#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
_LEAST_ASSIGN, _LEAST_WEAK = 12, 6
BLOCK = 256
CHUNK = 4096  # code points of a text that spans are cut from


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """A non-empty array in slices of at most BLOCK items."""
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK)))


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each integer the earlier ones joined, 0 for the first."""
    begin = F.expr("struct(0 AS now, CAST(array() AS array<int>) AS out)")
    return F.aggregate(values, begin, lambda acc, x: F.struct(join(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))["out"]


def _largest_before(values: Column) -> Column:
    """For each of a non-empty array the largest of the earlier ones, 0 for the first."""

    def placed(blocks: Column) -> Column:
        firsts = _before(F.transform(blocks, F.array_max), F.greatest)
        return F.flatten(F.zip_with(blocks, firsts, lambda block, first: F.transform(_before(block, F.greatest), lambda x: F.greatest(x, first))))

    return _let(_blocks(values), placed)


def _spans(text: Column, pattern: str, kind: str, found: Column, values: Column | None = None) -> Column:
    """array<struct<start, kind, end, size>>: between the matches lie the pieces that split() gives, so lengths add up to positions."""
    number = KINDS.index(kind)
    gaps = F.split(text, pattern, -1)
    sizes = F.transform(values if values is not None else found, F.length)
    steps = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("match"), sizes.alias("size"))
    span = "struct<start:int,kind:int,end:int,size:int>"
    empty = F.expr(f"CAST(array() AS array<{span}>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["match"]
        one = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["size"].alias("size"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def in_block(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("out")), add)

    def placed(blocks: Column) -> Column:
        begins = _before(F.transform(blocks, lambda r: r["at"]), lambda a, b: a + b)
        shift = lambda s, by: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["size"].alias("size"))
        return F.flatten(F.zip_with(blocks, begins, lambda r, by: F.transform(r["out"], lambda s: shift(s, by))))

    return F.when(F.size(found) > 0, _let(F.transform(_blocks(steps), in_block), placed)).otherwise(empty)


def _parts(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """Adds text__ and the arrays assign, access, hex, ident, weak and endpoint; matches come first, so that each pattern is searched once."""
    text = F.col("text__")
    out = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text__"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "weak": WEAK, "endpoint": ENDPOINT}
    # What a pattern can't match without is looked for first: a plain search costs a small part of a pattern's.
    signed, none = F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), F.expr("CAST(array() AS array<string>)")
    may = dict.fromkeys(patterns, signed) | {"access": F.contains(text, F.lit("AKIA")), "hex": F.lit(True)}
    out = out.withColumns({f"{k}__": F.when(may[k], F.regexp_extract_all("text__", F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    values = F.when(F.size("assign__") > 0, F.regexp_extract_all("text__", F.lit(ASSIGN), F.lit(2))).otherwise(F.col("assign__"))
    made = {k: _spans(text, p, k, F.col(f"{k}__"), values if k == "assign" else None) for k, p in patterns.items()}
    return out.withColumns({f"{k}__": v for k, v in made.items()})


def _may_link() -> Column:
    """Whether a row has an identifier, a secret and a weak candidate at all; few have."""
    secret, ident = F.concat("short__", "weak__", "strong__", "hex__"), F.concat("ident__", "access__")
    return (F.size(secret) > 0) & (F.size(ident) > 0) & (F.size("ident__") + F.size("short__") + F.size("weak__") + F.size("endpoint__") > 0)


def _near(parts: DataFrame, scope: int, flags: dict[str, Column]) -> DataFrame:
    """The distinct parts with a flag for each condition: whether a part that meets it, and doesn't overlap, is near."""
    # Each part twice, where it ends (0) and where it begins (1); at one place ends come first.
    events = parts.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    events = events.withColumn("at", F.when(F.col("side") == 0, F.col("end")).otherwise(F.col("start")))
    before = Window.partitionBy("row__").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row__").orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    ends = lambda which: F.max(F.when(which & (F.col("side") == 0), F.col("at"))).over(before)
    begins = lambda which: F.min(F.when(which & (F.col("side") == 1), F.col("at"))).over(after)
    is_break = F.col("part") == "break"

    def near(which: Column) -> Column:
        back = (F.col("start") - ends(which) <= scope) & (ends(which) > F.coalesce(ends(is_break), F.lit(-1)))
        ahead = (begins(which) - F.col("end") <= scope) & (begins(which) < F.coalesce(begins(is_break), F.lit(2**31 - 1)))
        return F.coalesce(F.when(F.col("side") == 1, back).otherwise(ahead), F.lit(False))

    flagged = events.withColumns({k: near(v) for k, v in flags.items()})
    return flagged.groupBy("row__", "start", "kind", "end", "part", "is_weak").agg(*(F.max(k).alias(k) for k in flags))


def _linked(both: DataFrame, scope: int) -> DataFrame:
    """row__ and the weak spans that complementary parts stand near to. An endpoint goes with an identifier and a secret that complete others."""

    def typed(spans: Column, part: str, weak: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(part).alias("part"), F.lit(weak).alias("is_weak")))

    every = F.concat(
        typed(F.concat("strong__", "hex__"), "secret", False), typed(F.concat("short__", "weak__"), "secret", True),
        typed(F.col("access__"), "ident", False), typed(F.col("ident__"), "ident", True), typed(F.col("endpoint__"), "endpoint", True),
        typed(F.col("breaks__"), "break", False),
    )
    secret, ident = F.col("part") == "secret", F.col("part") == "ident"
    parts = _near(both.select("row__", F.inline(every)), scope, {"near_secret": secret, "near_ident": ident})
    parts = parts.withColumn("whole", (secret & F.col("near_ident")) | (ident & F.col("near_secret"))).drop("near_secret", "near_ident")
    parts = _near(parts.withColumn("is_weak", F.col("is_weak") & (F.col("whole") | (F.col("part") == "endpoint"))), scope, {"secret": secret & F.col("whole"), "ident": ident & F.col("whole")})
    told = (F.col("part") != "endpoint") | (F.col("secret") & F.col("ident"))
    return parts.where(F.col("is_weak") & told).groupBy("row__").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked__"))


def _digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300, whole_rows: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (array of start, kind number, end).

    With ``whole_rows`` the input's row comes along as struct ``doc``.
    """
    keep = [F.struct("*").alias("doc")] if whole_rows else [F.col(id_col).alias("id__")]
    found = _parts(docs, text_col, keep)
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    assign = F.col("assign__")
    rows = found.select(
        "doc" if whole_rows else "id__",
        F.monotonically_increasing_id().alias("row__"),
        bare(F.filter(assign, lambda s: s["size"] >= _LEAST_ASSIGN)).alias("strong__"),
        bare(F.transform(F.filter(assign, lambda s: (s["size"] < _LEAST_ASSIGN) & (s["size"] >= _LEAST_WEAK)), lambda s: s.withField("kind", F.lit(KINDS.index("weak"))))).alias("short__"),
        *(bare(F.col(f"{k}__")).alias(f"{k}__") for k in KINDS[1:]),
        "text__",
    )
    breaks = _spans(F.col("text__"), BREAK, "assign", F.regexp_extract_all("text__", F.lit(BREAK), F.lit(0)))
    rows = rows.withColumn("breaks__", F.when(_may_link(), bare(breaks))).drop("text__")
    rows = written(rows, "parts", scratch(docs.sparkSession))
    both = rows.where(_may_link())
    alone = rows.where(~_may_link())  # these, nearly all, aren't shuffled
    linked = both.join(_linked(both, scope), "row__", "left")
    rows = linked.unionByName(alone.withColumn("linked__", F.lit(None).cast(linked.schema["linked__"].dataType)))
    base = F.array_sort(F.concat("strong__", "access__", "hex__"))
    every = F.when(F.col("linked__").isNull(), base).otherwise(F.array_sort(F.concat(base, "linked__")))
    return rows.select(
        *(["doc"] if whole_rows else []),
        (F.col("doc").getField(id_col) if whole_rows else F.col("id__")).alias("doc_id"),
        *(F.size(c).cast("long").alias(n) for c, n in (("strong__", "n_assign"), ("access__", "n_access"), ("hex__", "n_hex"))),
        F.sha2(_digest(base), 256).alias("base_sha256"),
        _digest(every).alias("spans"),
        every.alias("found"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", scope: int = 300) -> DataFrame:
    """The rows of ``docs`` with every span's text replaced by ``mark``; spans that overlap become one mark."""
    text = F.coalesce(F.col("doc").getField(text_col).cast("string"), F.lit(""))

    def between(chunks: Column, a: Column, b: Column) -> Column:
        """The text from a to b, of chunks of CHUNK code points."""
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        middle = F.array_join(F.slice(chunks, i + 2, F.greatest(F.lit(0), j - i - 1)), "")
        far = F.concat(F.substring(chunk(i), a % CHUNK + 1, F.lit(CHUNK)), middle, F.substring(chunk(j), F.lit(1), b % CHUNK))
        return F.when(i == j, F.substring(chunk(i), a % CHUNK + 1, b - a)).otherwise(far)

    def replaced(chunks: Column, spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        gaps = F.zip_with(spans, _largest_before(ends), lambda s, at: F.when(s["start"] >= at, F.concat(between(chunks, at, s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(gaps, ""), between(chunks, F.array_max(ends), F.length(text)))

    chunked = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    clean = F.when(F.size("found") > 0, _let(chunked, lambda chunks: replaced(chunks, F.col("found"))))
    rows = scan(docs, id_col, text_col, scope, whole_rows=True).select("doc", clean.alias("clean__"))
    names = docs.columns
    return rows.select(*(F.coalesce("clean__", F.col("doc")[c]).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in names))
