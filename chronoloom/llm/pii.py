"""Personal data: exact base kinds, and bootstrapped contextual extraction of what these miss.

Base spans (e-mail, IP address, payment card, phone) are the seed entities. Words that hold a digit or an at sign are
the instances. Lexical patterns are what stands around an instance: one to three words before it, one or two after it,
the words on both sides, and the word before together with the instance's shape. Patterns and instances form a graph
that is scored in rounds: a pattern's confidence for a kind is the share of known ones among its distinct instances.
Those known to be of other kinds and those that look like no identifier are its negatives; those that look like one and
are not known yet weigh ``unknown`` each. An instance's confidence is that of any of its patterns being right. Instances above the threshold join the known ones and teach patterns in the next round; in the end
every occurrence of one is a span.

Only DataFrame functions. The texts are read once; only spans and instances leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import let, written

_SPACE = r"\x20\x09-\x0D"
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base kinds, written without backtracking. A run that cannot match from its first character can't from a later one,
#: so the guards in front only save trying; \G lets a match begin where the last one of its kind ended.
KINDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_INSTANCE = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,found:string>>"


def running(values: Column, add, neutral: Column) -> Column:
    """Running totals of an array under an associative ``add``: doubling steps, each one pass, no array is grown."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda v, i: add(F.coalesce(F.get(acc, i - far), neutral), v)).cast("array<int>")

    return F.aggregate(steps, values.cast("array<int>"), step)


def _located(text: Column, pattern: str) -> Column:
    """Matches with start (code points), the text before them up to the last match, and the text after up to the next."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)

    def place(v: Column) -> Column:
        lengths = F.transform(v["m"], lambda m, i: F.length(F.get(v["b"], i)) + F.length(m))

        def of(ends: Column) -> Column:
            return F.transform(v["m"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), m.alias("found"), F.get(v["b"], i).alias("before"), F.get(v["b"], i + 1).alias("after")))

        return let(let(lengths, lambda n: running(n, lambda x, y: x + y, F.lit(0))), of)

    return let(F.struct(between.alias("b"), matches.alias("m")), place)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")
        return F.forall(F.split(s, r"\."), small)
    if kind == "card":
        return F.when(F.length(_digits(s)).between(12, 19), _luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans of a text by start, then kind as listed."""

    def of(rank: int, kind: str) -> Column:
        sign = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, F.lit(True))
        good = F.filter(_located(text, KINDS[kind]), lambda m: _valid(kind, m["found"]))
        spans = F.transform(good, lambda m: F.struct(m["start"], F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["found"])).alias("end"), m["found"]))
        return F.when(sign, spans).otherwise(F.array().cast(_SPAN))

    return F.sort_array(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


#: Parameter: context is what whole words stand within so many characters of an instance, up to the instance next to it.
NEAR = 80


def _words(text: Column) -> Column:
    """Lower-case words that hold a letter or stand for one."""
    return F.filter(F.split(F.lower(text), f"[{_SPACE}]+"), lambda w: w.rlike(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"))


def _instances(text: Column) -> Column:
    """Words with a digit or an at sign, without outer punctuation, and the three words before and two after.

    A neighbour that begins or ends beyond ``NEAR`` characters is left out whole.
    """

    def one(m: Column) -> Column:
        lead = F.length(F.regexp_extract(m["found"], r"^[^A-Za-z0-9+]*+", 0))
        core = F.regexp_replace(m["found"], r"^[^A-Za-z0-9+]++|(?<![^A-Za-z0-9])[^A-Za-z0-9]++$|[.,;:!?)\]}\"']++$", "")
        before = F.when(F.length(m["before"]) > NEAR, F.regexp_replace(F.right(m["before"], F.lit(NEAR)), f"^[^{_SPACE}]++", "")).otherwise(m["before"])
        after = F.when(F.length(m["after"]) > NEAR, F.regexp_replace(F.substring(m["after"], 1, NEAR), f"(?<![^{_SPACE}])[^{_SPACE}]++$", "")).otherwise(m["after"])
        left, right = _words(before), _words(after)
        return F.struct((m["start"] + lead).alias("start"), core.alias("found"), F.slice(left, F.greatest(F.lit(1), F.size(left) - 2), 3).alias("left"), F.slice(right, 1, 2).alias("right"))

    return F.transform(_located(text, _INSTANCE), lambda m: let(m, one))


def _with_known(base: Column, seen: Column) -> Column:
    """The instances, each with the first base span that it overlaps (``known``, else null), by one merge of both.

    That is the first span that ends behind the instance's start, if it begins before the instance's end. Running maxima
    of the spans' ends rise, so its number is the number of maxima up to the start.
    """

    def merged(v: Column) -> Column:
        tops = F.transform(v["tops"], lambda t: F.struct(t.alias("at"), F.lit(0).alias("what")))
        all_of = F.array_sort(F.concat(tops, F.transform(v["seen"], lambda i: F.struct(i["start"].alias("at"), F.lit(1).alias("what")))))
        places = F.filter(F.transform(all_of, lambda e, p: F.when(e["what"] == 1, p).otherwise(-1)), lambda p: p >= 0)

        def known(i: Column, k: Column, places: Column) -> Column:
            span = F.get(v["base"], F.get(places, k) - k)
            return F.struct(i["start"], i["found"], i["left"], i["right"], F.when(span["start"] < i["start"] + F.length(i["found"]), span).alias("known"))

        return let(places, lambda places: F.transform(v["seen"], lambda i, k: known(i, k, places)))

    tops = let(base, lambda b: running(F.transform(b, lambda s: s["end"]), F.greatest, F.lit(0)))
    return let(F.struct(base.alias("base"), seen.alias("seen"), tops.alias("tops")), merged)


def _shape(found: Column) -> Column:
    """Runs of digits as 9, of other letters as a."""
    return F.regexp_replace(F.regexp_replace(found, "[0-9]+", "9"), r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "a")


def _patterns(found: Column, left: Column, right: Column) -> Column:
    """The lexical patterns that an occurrence of an instance has."""
    n, m = F.size(left), F.size(right)
    last = lambda k: F.array_join(F.slice(left, n - k + 1, k), " ")
    first = lambda k: F.array_join(F.slice(right, 1, k), " ")
    all_of = [F.when(n >= k, F.concat(last(k), F.lit(" _"))) for k in (1, 2, 3)]
    all_of += [F.when(m >= k, F.concat(F.lit("_ "), first(k))) for k in (1, 2)]
    all_of += [F.when((n >= 1) & (m >= 1), F.concat(last(1), F.lit(" _ "), first(1)))]
    all_of += [F.when(n >= 1, F.concat(last(1), F.lit(" _ is "), _shape(found)))]
    return F.array_compact(F.array(*all_of))


def extract(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, row number, base spans and instances, written to the shared folder."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_no", F.monotonically_increasing_id())
    both = let(F.struct(base_spans(text).alias("base"), _instances(text).alias("seen")), lambda v: F.struct(v["base"].alias("base"), _with_known(v["base"], v["seen"]).alias("seen")))
    return written(rows.select("doc_id", "row_no", both.alias("v")).select("doc_id", "row_no", "v.base", "v.seen"), "pii")


def bootstrap(rows: DataFrame, *, rounds: int = 2, support: int = 4, threshold: float = 0.9, unknown: float = 0.1) -> DataFrame:
    """(found, kind, score) of the instances that high-confidence patterns discover, beyond the seeds. Input: what ``extract`` gives.

    An instance is discovered only if it looks like an identifier: at least six digits, or an at sign between letters;
    as a card only if its digits pass for one.
    """
    i = F.col("i")
    one = rows.select(F.explode("seen").alias("i")).withColumn("s", i["known"])
    # within a base span only its first word counts, as the whole span
    one = one.where(F.col("s").isNull() | (i["start"] <= F.col("s.start")))
    found = F.coalesce("s.found", i["found"])
    one = one.select(found.alias("found"), F.col("s.kind").alias("kind"), F.explode(_patterns(found, i["left"], i["right"])).alias("pattern"))
    edges = written(one.groupBy("pattern", "found").agg(F.min("kind").alias("seed")), "edges")
    known = edges.where(F.col("seed").isNotNull()).groupBy("found").agg(F.min("seed").alias("kind"), F.lit(1.0).alias("score"))
    looks = (F.length(_digits(F.col("found"))) >= 6) | F.col("found").rlike("[A-Za-z0-9]@[A-Za-z0-9]")
    for _ in range(rounds):
        taught = edges.join(known, "found").groupBy("pattern", "kind").agg(F.count("*").alias("known")).where(F.col("known") >= support)
        taught = written(taught.groupBy("pattern").agg(F.max_by(F.struct("kind", "known"), F.struct("known", "kind")).alias("t")).select("pattern", "t.*"), "taught")
        # negatives are counted for the patterns alone that enough seeds have
        graph = edges.join(taught.select("pattern", F.col("kind").alias("as"), "known"), "pattern").join(known.select("found", "kind"), "found", "left")
        weight = F.when(F.col("kind").isNull() & looks, F.lit(unknown)).otherwise(F.lit(1.0))
        patterns = graph.groupBy("pattern", "as", "known").agg(F.sum(weight).alias("n")).select("pattern", "as", (F.col("known") / F.col("n")).alias("p")).where(F.col("p") >= threshold)
        patterns = written(patterns, "patterns")
        doubt = F.exp(F.sum(F.log(1.001 - F.col("p"))))
        fresh = edges.where(F.col("seed").isNull() & looks).join(patterns, "pattern").groupBy("found", "as").agg(F.least(F.lit(1.0), 1.001 - doubt).alias("score"))
        fresh = fresh.where((F.col("score") >= threshold) & ((F.col("as") != "card") | _valid("card", F.col("found")))).groupBy("found").agg(F.max_by(F.struct(F.col("as").alias("kind"), "score"), F.struct("score", "as")).alias("k")).select("found", "k.*")
        known = written(known.unionByName(fresh.join(known.select("found"), "found", "left_anti")), "known")
    return known.join(edges.where(F.col("seed").isNotNull()).select("found").distinct(), "found", "left_anti")


def find(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, ``base`` and ``spans`` (base and discovered) by start, then kind as listed.

    Input: doc_id, text and any other columns, which are not carried. A null text counts as empty and has no spans;
    rows with a null or repeated doc_id each give a row; an empty table gives none. Offsets are in code points, ends
    exclusive. A discovered span never overlaps a base span. A string that base finds as two kinds has both spans and
    teaches as the first of them; one that is discovered has one kind, that of the higher score. A text of very many
    matches takes time in proportion to them, but for a logarithm.
    """
    rows = extract(docs)
    found = bootstrap(rows, **options)
    spots = rows.select("row_no", F.explode("seen").alias("i")).where(F.col("i.known").isNull())
    spots = spots.select("row_no", F.col("i.start").alias("start"), F.col("i.found").alias("found")).join(found.select("found", "kind"), "found")
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    more = spots.groupBy("row_no").agg(F.collect_list(F.struct("start", rank.alias("rank"), "kind", (F.col("start") + F.length("found")).alias("end"), "found")).alias("more"))
    return rows.join(more, "row_no", "left").select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base kinds, and all spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
