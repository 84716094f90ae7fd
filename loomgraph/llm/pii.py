"""Personal data: base patterns and bootstrapped contextual extraction, in built-in functions only.

Base spans come from four patterns and their checks and stay as they are.  The bootstrap works on mentions
(tokens with a digit, a plus or an at sign; what a phone or card pattern joins over spaces is one mention):

* Seeds are mentions that hold a base span, and hexadecimal strings of 32 or more places (kind ``secret``,
  which has no base pattern: a secret is reported only where its context says so).
* Every mention has up to three lexical patterns: the words before it (the last where that is a word ending
  in ``:``, ``=`` or ``#``, else the last two), the two words after it, and the word on either side.
* Patterns and the distinct values seen in them form a graph.  A pattern's confidence in a kind is the lower
  end of Wilson's interval for the share of its values that are seeds or trusted finds of that kind (each
  counts by its trust), so copies of one passage count once and few values prove little at any corpus size.
  Patterns of ``confidence`` or more are trusted; a candidate's trust is the noisy-or of its trusted
  patterns; trusted finds then count for the other patterns they stand in, and rounds go on until no pattern
  and no find is new.
* Candidates (mentions without a base span, of ``min_chars`` characters or more) in a trusted pattern become
  spans of its kind.  A number that has a base pattern's form and fails its check is never of that kind.

Regular expressions are possessive and start only where a match can start, so a text's length costs linear
time and no stack.  Positions are code points, ends exclusive.  Context words are looked for in the
``context_chars`` characters beside a mention.

Defined results: null text is empty and has no spans; repeated rows are reported each; base spans of
different kinds may overlap (redaction merges them), added ones overlap nothing; no rows give no rows;
columns other than doc_id and text are passed on by ``redact`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import _store

_LOCAL = "A-Za-z0-9._%+-"
#: Kind -> pattern, in the order in which spans are listed.  A group's possessive repetition is a loop, not a
#: recursion; the guards keep a search from starting inside a run that it has already failed on.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MENTION = r"(?<!\S)[^\s0-9@+]*+(?:\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9])++|[0-9@+])\S*+"
#: Long hexadecimal strings are the seeds of a fifth kind.
_SECRET = r"(?<![A-Za-z0-9])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"
KINDS = [*PATTERNS, "secret"]
SPAN = "struct<rank:int,kind:string,start:int,end:int>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})?){3}$")
    digits = _digits(m)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _sums(sizes: Column, block: int = 256) -> Column:
    """Sums of all numbers before each one: within blocks, then over the blocks' totals, so a long array is cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
    run = lambda xs: F.aggregate(xs, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums")))
    inner = F.transform(blocks, run)
    outer = run(F.transform(inner, lambda x: x["at"]))["sums"]
    return F.when(F.size(sizes) > 0, F.flatten(F.zip_with(inner, outer, lambda x, base: F.transform(x["sums"], lambda y: y + base)))).otherwise(F.array().cast("array<int>"))


def _starts(found: Column, between: Column) -> Column:
    """Start of each match; ``between`` are the texts around them."""
    gaps = F.slice(between, 1, F.size(found))
    steps = F.zip_with(found, gaps, lambda m, b: F.length(b) + F.length(m))
    return F.zip_with(_sums(steps), gaps, lambda at, b: at + F.length(b))


def _matched(docs: DataFrame) -> DataFrame:
    """``docs`` with (_pii_m, _pii_t, _pii_s)_<kind>: matches, texts around them and starts, of base patterns and mentions.

    Each step is a projection of its own: an expression that later steps use many times is computed once.
    """
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    digit = text.rlike("[0-9]")
    may = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")), "mention": text.rlike("[0-9@+]")}
    patterns = PATTERNS | {"mention": _MENTION}
    docs = docs.withColumns({f"_pii_m_{k}": F.when(may[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    docs = docs.withColumns({f"_pii_t_{k}": F.when(F.size(f"_pii_m_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, p in patterns.items()})
    return docs.withColumns({f"_pii_s_{k}": _starts(F.col(f"_pii_m_{k}"), F.col(f"_pii_t_{k}")) for k in patterns})


def _kind_spans(rank: int, kind: str) -> Column:
    spans = F.zip_with(f"_pii_m_{kind}", f"_pii_s_{kind}", lambda m, s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))
    return F.transform(F.filter(spans, lambda x: _valid(kind, x["value"])), lambda x: F.struct(*[x[c].alias(c) for c in ("rank", "kind", "start", "end")]))


def _contexts(before: Column, after: Column) -> Column:
    """array<string>: the lexical patterns of a place between two texts."""
    clean = lambda words: F.nullif(F.regexp_replace(F.lower(words), r"\s+", " "), F.lit(""))
    one = clean(F.regexp_extract(before, r"(?<!\S)(\S++)\s++$", 1))
    two = clean(F.regexp_extract(before, r"(?<!\S)(\S++\s++\S++)\s++$", 1))
    left = F.when(one.rlike(r"\p{L}.*[:=#]$"), one).otherwise(two)
    next_ = clean(F.regexp_extract(after, r"^\s++(\S++)(?!\S)", 1))
    right = clean(F.regexp_extract(after, r"^\s++(\S++\s++\S++)(?!\S)", 1))
    return F.filter(F.array(F.concat(left, F.lit(" _")), F.concat(F.lit("_ "), right), F.concat(one, F.lit(" _ "), next_)), lambda p: p.isNotNull())


def _mentions(min_chars: int, context_chars: int) -> Column:
    """array<struct<patterns, value, start, end, rank, refuted, candidate>>: a text's mentions with their patterns; ``rank`` is the kind of a seed, else null."""
    found, between = F.col("_pii_m_mention"), F.col("_pii_t_mention")
    # only what stands right beside a mention is looked at
    before = F.transform(F.slice(between, 1, F.size(found)), lambda b: F.substr(b, F.greatest(F.length(b) - context_chars, F.lit(0)) + 1))
    after = F.transform(F.slice(between, 2, F.size(found)), lambda b: F.substr(b, F.lit(1), F.lit(context_chars)))
    rows = F.arrays_zip(found.alias("m"), before.alias("b"), after.alias("a"), F.col("_pii_s_mention").alias("s"))

    def describe(x: Column) -> Column:
        m = x["m"]
        inner = F.regexp_replace(m, r"^[^\p{L}\p{N}@+]++", "")
        value = F.regexp_replace(inner, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        start = x["s"] + F.length(m) - F.length(inner)
        rank, seed = F.lit(None).cast("int"), F.lit(None).cast("string")
        for k, (kind, pattern) in reversed(list(enumerate([*PATTERNS.items(), ("secret", _SECRET)]))):
            own = F.regexp_extract(m, pattern, 0)
            good = (own != "") & (F.lit(True) if kind == "secret" else _valid(kind, own))
            rank, seed = F.when(good, F.lit(k)).otherwise(rank), F.when(good, own).otherwise(seed)
        refuted = F.when(value.rlike(r"^[0-9]++(?:\.[0-9]++){3}+$"), 1).when(value.rlike(r"^[0-9](?:[\x20-]?[0-9])++$") & F.length(_digits(value)).between(13, 19), 2).when(value.rlike(r"^\+[0-9]"), 3)
        # a secret needs a context, so its seeds may be found themselves
        candidate = (rank.isNull() | (rank == len(PATTERNS))) & (F.length(value) >= min_chars) & value.rlike(r"^\S+$")
        return F.struct(_contexts(x["b"], x["a"]).alias("patterns"), F.coalesce(seed, value).alias("value"), start.alias("start"), (start + F.length(value)).alias("end"), rank.alias("rank"), refuted.alias("refuted"), candidate.alias("candidate"))

    return F.filter(F.transform(rows, describe), lambda m: F.size(m["patterns"]) > 0)


def graph(found: DataFrame) -> DataFrame:
    """(pattern, value, rank, refuted, candidate): the distinct edges of a table with ``_pii_mentions``."""
    each = found.select(F.explode("_pii_mentions").alias("m")).select(F.explode("m.patterns").alias("pattern"), "m.value", "m.rank", "m.refuted", "m.candidate")
    return each.groupBy("pattern", "value").agg(F.min("rank").alias("rank"), F.min("refuted").alias("refuted"), F.max("candidate").alias("candidate"))


def wilson(hits: Column, total: Column, z: float) -> Column:
    """Lower end of Wilson's interval for ``hits`` of ``total``."""
    p, zz = hits / total, z * z
    return (p + zz / (2 * total) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / total + zz / (4 * total * total))) / (1 + zz / total)


def score_patterns(edges: DataFrame, space: _store.Workspace, confidence: float = 0.6, z: float = 2.576) -> DataFrame:
    """(pattern, rank, confidence) of the trusted patterns of a written ``graph``, at the fixed point of the rounds."""
    # a pattern of fewer values cannot be trusted, whatever they are
    least = z * z * confidence / (1 - confidence)
    totals = space.table(edges.groupBy("pattern").agg(F.count("*").alias("total")).where(F.col("total") >= least), "totals")
    seeds = space.table(edges.where("rank IS NOT NULL").groupBy("pattern", "rank").agg(F.count("*").cast("double").alias("hits")).join(totals.select("pattern"), "pattern", "left_semi"), "seeds")
    open_ = space.table(edges.where("rank IS NULL AND candidate").select("pattern", "value", "refuted").join(totals.select("pattern"), "pattern", "left_semi"), "open")
    hits, before = seeds, None
    while True:
        scored = hits.groupBy("pattern", "rank").agg(F.sum("hits").alias("hits")).join(totals, "pattern")
        scored = scored.select("pattern", "rank", wilson(F.least("hits", "total"), F.col("total"), z).alias("confidence")).where(F.col("confidence") >= confidence)
        trusted = space.table(scored, "trusted")
        finds = open_.join(trusted, "pattern").where("refuted IS NULL OR refuted <> rank")
        finds = space.table(finds.groupBy("value", "rank").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("hits")), "finds")
        now = trusted.count(), finds.count()
        if now == before or not now[1]:
            return trusted
        before = now
        gained = open_.join(finds, "value").where("refuted IS NULL OR refuted <> rank").groupBy("pattern", "rank").agg(F.sum("hits").alias("hits"))
        hits = seeds.unionByName(gained)


def _added(stage: DataFrame, trusted: DataFrame) -> DataFrame:
    """(_pii_row, start, end, rank): candidates in trusted patterns that overlap no base span."""
    each = stage.select("_pii_row", F.explode("_pii_mentions").alias("m")).where("m.candidate").select("_pii_row", "m.start", "m.end", "m.refuted", F.explode("m.patterns").alias("pattern"))
    hits = each.join(trusted, "pattern").where("refuted IS NULL OR refuted <> rank")
    return hits.groupBy("_pii_row", "start", "end").agg(F.max_by("rank", F.struct("confidence", -F.col("rank"))).alias("rank"))


def _apart(stage: DataFrame, added: DataFrame) -> DataFrame:
    """The rows of ``added`` that overlap no base span of their text."""
    base = stage.select("_pii_row", "_pii_base").join(added.select("_pii_row").distinct(), "_pii_row", "left_semi").select("_pii_row", F.explode("_pii_base").alias("s")).select("_pii_row", "s.start", "s.end")
    both = added.unionByName(base.withColumn("rank", F.lit(None).cast("int")))
    order = Window.partitionBy("_pii_row").orderBy("start", "end")
    is_base = F.col("rank").isNull()
    last = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    placed = both.withColumn("_last", last).withColumn("_first", first)
    return placed.where("rank IS NOT NULL AND coalesce(_last <= start, true) AND coalesce(_first >= end, true)").drop("_last", "_first")


def detect(docs: DataFrame, space: _store.Workspace, confidence: float = 0.6, z: float = 2.576, min_chars: int = 6, context_chars: int = 200, keep: bool = False) -> DataFrame:
    """The columns of ``docs`` (``text`` only where ``keep``), with ``_pii_base`` and ``_pii_spans`` (arrays of ``SPAN``).

    ``docs`` may have any columns; ``text`` is read.  Helper columns start with ``_pii``.  The result reads
    tables of ``space``.
    """
    base = F.concat(*[_kind_spans(rank, kind) for rank, kind in enumerate(PATTERNS)])
    own = docs.columns if keep else [c for c in docs.columns if c != "text"]
    found = _matched(docs).select(*own, base.alias("_pii_base"), _mentions(min_chars, context_chars).alias("_pii_mentions"), F.monotonically_increasing_id().alias("_pii_row"))
    stage = space.table(found, "found")
    trusted = score_patterns(space.table(graph(stage), "graph"), space, confidence, z)
    if trusted.isEmpty():
        return stage.withColumn("_pii_spans", F.col("_pii_base"))
    added = space.table(_added(stage, trusted), "candidates")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    span = F.struct("rank", F.element_at(kinds, F.col("rank") + 1).alias("kind"), "start", "end")
    added = space.table(_apart(stage, added).groupBy("_pii_row").agg(F.collect_list(span).alias("_pii_added")), "added")
    joined = stage.join(added, "_pii_row", "left")
    return joined.withColumn("_pii_spans", F.array_sort(F.concat("_pii_base", F.coalesce("_pii_added", F.array().cast(f"array<{SPAN}>"))))).drop("_pii_added")


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of (doc_id, text)."""
    with _store.Workspace(docs.sparkSession, "pii") as space:
        found = detect(docs.select("doc_id", "text"), space, **options)
        counts = [_count("_pii_base", kind).alias(f"n_{kind}") for kind in PATTERNS]
        result = found.select("doc_id", *counts, F.sha2(listed(F.col("_pii_base")), 256).alias("base_sha256"), listed(F.col("_pii_spans")).alias("spans"))
        return space.table(result, "report", keep=True)


def redact(docs: DataFrame, space: _store.Workspace | None = None, **options) -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>``; where spans overlap, the first kind stands for all.

    The result reads tables of ``space``, which its owner frees once the result is written; without one,
    ``_store.release`` does.
    """
    if space is None:
        _store.hold(space := _store.Workspace(docs.sparkSession, "pii"))
    found = detect(docs, space, keep=True, **options)
    ordered = F.array_sort(F.transform("_pii_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        end = -s["minus"]
        piece = F.concat(a["out"], F.substr("text", a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] >= a["at"], F.struct(end.alias("at"), piece.alias("out"))).otherwise(F.struct(F.greatest(a["at"], end).alias("at"), a["out"].alias("out")))

    done = F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], F.substr("text", a["at"] + 1)))
    text = F.when(F.size("_pii_spans") > 0, done).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
