"""Personal data: validated formats as seeds, and bootstrapped contextual extraction of further identifiers.

One pass over the texts finds the spans of four base kinds and all mentions with the words on both sides of them. A
mention is a word with a digit or an at sign, or a run of words of digits and phone punctuation; of key=value only the
value is one. Seeds are the mentions that are base spans, and those of a fifth kind, secret: access keys and long
hexadecimal tokens of public formats. The lexical patterns of a mention are its words to the left and right, its shape,
and how it begins and ends. Patterns and instances score each other over their graph in rounds: a pattern by how many of
its instances are believed to be of one kind, an instance by the best of the patterns that extract it. Mentions that have a base kind's
form but fail its validation are never believed. Patterns of high confidence yield new spans. Only DataFrame functions are used; after the one pass all tables are narrow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import fresh, row_key, shared_folder, stage_table

#: The kinds in their order, with the format of each. A match begins where a run begins or a match ended.
KINDS = ("email", "ip", "card", "phone")
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Runs of words of digits and phone punctuation, or words with a digit or an at sign.
MENTION = r"(?<![^\x20\x09-\x0D])(?:[+(]*+[0-9][0-9().+-]*+(?:\x20[+(]*+[0-9][0-9().+-]*+)++(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: Public formats of access keys, and hexadecimal tokens of 128 bits and more.
SECRET = "secret"
SECRETS = r"^(?:AKIA[0-9A-Z]{16}|(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,})$"
FOUND = (*KINDS, SECRET)
#: Mentions of these forms that aren't base spans failed the validation: they are counter-examples of their patterns.
REFUSED = r"^(?:[0-9]++(?:\.[0-9]++){3}|[0-9](?:[\x20-]?[0-9]){11,}+|\+[0-9][\x20().0-9-]+[0-9])$"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
#: Up to this many rows are broadcast to join texts; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Matches of a text whose lengths are added up together.
CHUNK = 128
#: Code points of a cell, in which mentions meet the base spans that they overlap.
CELL = 256


@dataclass(frozen=True)
class PiiSettings:
    """A pattern needs `support` different seeds of its kind and the confidence; rounds of mutual scoring.

    An instance takes belief from patterns of at least `passing` only, so that doubtful ones don't raise each other. hidden:
    the part of the seeds, by a hash, that counts as unknown, to measure how many of them the patterns find again.
    """

    support: int = 5
    confidence: float = 0.8
    passing: float = 0.5
    rounds: int = 3
    hidden: float = 0.0


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _cut(array: Column) -> Column:
    """Consecutive pieces of an array, of CHUNK elements at most."""
    firsts = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(firsts, lambda first: F.slice(array, first, CHUNK))


def _places(text: Column, regex: str) -> Column:
    """Matches in their order: (gap, match, start), gap being the text since the match before; at the end a gap without match.

    Starts are added up in two levels, as appending to one array costs the square of the number of matches.
    """
    pairs = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    length = lambda p: F.length(p.gap) + F.coalesce(F.length(p.match), F.lit(0))

    def chunk_start(acc, chunk):
        return F.struct((acc.at + F.aggregate(chunk, F.lit(0), lambda n, p: n + length(p))).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))

    def place(acc, p):
        start = acc.at + F.length(p.gap)
        return F.struct((acc.at + length(p)).alias("at"), F.concat(acc.out, F.array(F.struct(p.gap.alias("gap"), p.match.alias("match"), start.alias("start")))).alias("out"))

    def placed(chunks):
        starts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), chunk_start).out
        none = F.array().cast("array<struct<gap:string,match:string,start:int>>")
        return F.flatten(F.zip_with(chunks, starts, lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), place).out))

    return _let(_let(pairs, _cut), placed)


def _luhn(digits: Column) -> Column:
    def doubled(i):
        digit = F.substr(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), doubled), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return _let(digits, lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, in code points, by start and kind; null text has none."""
    may = {"email": text.contains("@"), "ip": text.rlike(FORMATS["ip"]), "card": text.rlike(FORMATS["card"]), "phone": text.contains("+")}

    def spans(rank: int, kind: str) -> Column:
        valid = F.filter(_places(text, FORMATS[kind]), lambda p: p.match.isNotNull() & _valid(kind, p.match))
        made = F.transform(valid, lambda p: F.struct(p.start.alias("start"), F.lit(rank).alias("rank"), (p.start + F.length(p.match)).alias("end"), F.lit(kind).alias("kind")))
        return F.when(may[kind], made).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*[spans(r, k) for r, k in enumerate(KINDS)]))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _mentions(text: Column) -> Column:
    """Mentions without punctuation around them or a key before them: (start, end, core, left1, left2, right1)."""
    flat = lambda value: F.lower(F.translate(F.coalesce(value, F.lit("")), "\t\n\x0b\f\r", "     "))

    def one(places, p, i):
        # the words beside it may be mentions themselves; a gap between two begins and ends with white space
        before, second, after = F.get(places, i - 1), F.get(places, i - 2), F.get(places, i + 1)
        lead = F.length(F.regexp_extract(p.match, r"^(?:[A-Za-z_.-]++[=:]++)?+[^0-9A-Za-z+@(]*+", 0))
        core = F.regexp_replace(F.substr(p.match, lead + 1, F.length(p.match)), r"[^0-9A-Za-z]+$", "")
        near = F.rtrim(F.concat(flat(second.match), flat(before.gap), flat(before.match), flat(p.gap), flat(F.regexp_extract(p.match, r"^[A-Za-z_.-]++[=:]++", 0))))
        beyond = F.ltrim(F.concat(flat(F.substr(p.match, lead + F.length(core) + 1, F.length(p.match))), flat(after.gap), flat(after.match)))

        def made(x):
            rest = F.rtrim(F.substr(x.near, F.lit(1), F.length(x.near) - F.length(F.substring_index(x.near, " ", -1))))
            return F.struct(
                (p.start + x.lead).alias("start"), (p.start + x.lead + F.length(x.core)).alias("end"), x.core.alias("core"),
                F.substring_index(x.near, " ", -1).alias("left1"),
                F.when(rest != "", F.concat_ws(" ", F.substring_index(rest, " ", -1), F.substring_index(x.near, " ", -1))).otherwise("").alias("left2"),
                F.substring_index(x.beyond, " ", 1).alias("right1"),
            )

        return _let(F.struct(lead.alias("lead"), core.alias("core"), near.alias("near"), beyond.alias("beyond")), made)

    def all_of(places):
        mentioned = F.filter(F.transform(places, lambda p, i: F.when(p.match.isNotNull(), one(places, p, i))), lambda m: m.isNotNull())
        return F.filter(mentioned, lambda m: F.length(m.core) > 0)

    return F.when(text.rlike("[0-9@]"), _let(_places(text, MENTION), all_of))


def _shape(core: Column) -> Column:
    """Digits as 9 each and letters as one a; mixed runs are an x. Hexadecimal and upper-case codes have their length."""
    mixed = r"[A-Za-z]+[0-9][0-9A-Za-z]*|[0-9]+[A-Za-z][0-9A-Za-z]*"
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, mixed, "x"), "[A-Za-wyz]+", "a"), "[0-9]", "9")
    return F.when(core.rlike("^(?=[0-9]*[a-f])[0-9a-f]+$"), F.concat(F.lit("h"), F.length(core))).when(core.rlike("^(?=[0-9]*[A-Z])[0-9A-Z]+$"), F.concat(F.lit("u"), F.length(core))).otherwise(words)


def _patterns(m: Column) -> Column:
    """Hashes of the lexical patterns of a mention."""

    def of(shape):
        coarse = F.regexp_replace(shape, "9+", "9")
        begins, ends = F.lower(F.substring(m["core"], 1, 4)), F.lower(F.substring(m["core"], -8, 8))
        when = lambda k, good, *parts: F.when(good, F.xxhash64(F.lit(k), *parts))
        left1, left2, right1 = m["left1"], m["left2"], m["right1"]
        return F.array_compact(F.array(
            when(1, left1 != "", left1, shape), when(2, left2 != "", left2), when(3, right1 != "", right1, shape), when(4, (left1 != "") & (right1 != ""), left1, right1),
            when(5, F.length(m["core"]) >= 6, shape), when(6, (F.length(m["core"]) >= 8) & begins.rlike("[^0-9]"), begins, coarse), when(7, (F.length(m["core"]) >= 8) & ends.rlike("[^0-9]"), ends, coarse),
        ))

    return _let(_shape(m["core"]), of)


def find_spans(docs: DataFrame, settings: PiiSettings = PiiSettings()) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, uid and vid (its key), base (spans of the base kinds) and found (further spans).

    Spans are (start, rank, end, kind) in code points, end exclusive; base ones never change, and a further span doesn't
    overlap one. A further span is a seed of the fifth kind, or has the kind of its most trusted pattern. Null or empty
    text has no span, nor has an empty table. Repeated rows come as often as in docs, and count as one for the patterns;
    equal trusts go to the first kind. Columns other than doc_id and text aren't read, so they may have any name.
    """
    shared_folder(docs.sparkSession)
    text, key = F.coalesce("text", F.lit("")), ["uid", "vid"]
    scanned = stage_table(docs.select("doc_id", *row_key("doc_id", "text"), base_spans(text).alias("base"), _mentions(text).alias("mentions")), "pii-scan")

    # repeated rows have equal mentions; one of each goes on
    secret = F.when(F.col("m.core").rlike(SECRETS), SECRET)
    mentions = scanned.select(*key, F.explode("mentions").alias("m"))
    refused = F.col("m.core").rlike(REFUSED)
    mentions = mentions.select(*key, "m.start", "m.end", F.xxhash64("m.core").alias("instance"), secret.alias("secret"), refused.alias("refused"), _patterns(F.col("m")).alias("patterns")).distinct()
    mentions = stage_table(mentions, "pii-mentions")
    cell = lambda start, end: F.explode(F.sequence(F.floor(start / CELL), F.floor((end - 1) / CELL))).alias("cell")
    spans = scanned.select(*key, F.explode("base").alias("s")).select(*key, F.col("s.start").alias("from"), "s.rank", F.col("s.end").alias("to"), F.col("s.kind").alias("kind"), cell(F.col("s.start"), F.col("s.end"))).distinct()
    met = mentions.select(*key, "start", "end", cell(F.col("start"), F.col("end"))).join(spans, [*key, "cell"]).where("from < end and to > start")
    kinds = met.groupBy(*key, "start", "end").agg(F.min_by("kind", F.struct("from", "rank")).alias("base"))
    mentions = stage_table(mentions.join(kinds, [*key, "start", "end"], "left").withColumn("kind", F.coalesce("base", "secret")), "pii-kinds")

    shown = F.pmod(F.xxhash64(F.lit(3), "instance"), F.lit(1000)) >= int(1000 * settings.hidden)
    seeds = mentions.groupBy("instance").agg(F.max(F.when(shown, F.col("kind"))).alias("kind"), F.min(F.col("refused") & F.col("kind").isNull()).alias("never"))
    edges = mentions.select(F.explode("patterns").alias("pattern"), "instance").distinct()
    # patterns without `support` instances can't be believed in any round
    enough = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= settings.support)
    edges = edges.join(enough.select("pattern"), "pattern").join(seeds.withColumnRenamed("kind", "seed"), "instance").checkpoint()
    belief = edges.select("instance", "seed").distinct().select("instance", F.col("seed").alias("kind"), F.col("seed").isNotNull().cast("double").alias("belief")).checkpoint()
    trusted = None
    for _ in range(settings.rounds):
        scored = edges.join(belief, "instance").groupBy("pattern").agg(
            F.count("*").alias("n"),
            *[F.sum(F.when(F.col("kind") == k, F.col("belief")).otherwise(0.0)).alias(f"of_{k}") for k in FOUND], *[F.count_if(F.col("seed") == k).alias(f"seeds_{k}") for k in FOUND],
        )
        most = F.greatest(*[F.col(f"of_{k}") for k in FOUND])
        best = lambda made: F.coalesce(*[F.when(F.col(f"of_{k}") == most, made(k)) for k in FOUND])  # noqa: B023, E731
        scored = scored.select("pattern", (most / (F.col("n") + 0.5)).alias("trust"), best(F.lit).alias("of"), best(lambda k: F.col(f"seeds_{k}")).alias("seeds"))
        trusted = scored.where((F.col("seeds") >= settings.support) & (F.col("trust") >= settings.passing)).drop("seeds").checkpoint()
        raised = edges.where("seed is null and not never").join(trusted, "pattern").groupBy("instance").agg(F.max(F.struct("trust", "of")).alias("best"))
        belief = belief.join(raised, "instance", "left").select("instance", F.coalesce("best.of", "kind").alias("kind"), F.coalesce("best.trust", "belief").alias("belief")).checkpoint()

    sure = trusted.where(F.col("trust") >= settings.confidence)
    unknown = F.col("kind").isNull() & ~F.col("refused") | F.col("kind").isNotNull() & ~shown
    open_ = mentions.where(unknown).select(*key, "start", "end", F.explode("patterns").alias("pattern"))
    rank = F.coalesce(*[F.when(F.col("of") == k, r) for r, k in enumerate(FOUND)]).cast("int")
    hits = open_.join(sure, "pattern").groupBy(*key, "start", "end").agg(F.max_by("of", F.struct("trust", -rank)).alias("of"))
    hits = hits.union(mentions.where("base is null and secret is not null").where(shown).select(*key, "start", "end", F.col("secret")))
    found = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "end", F.col("of").alias("kind")))).alias("found"))
    return scanned.select("doc_id", *key, "base").join(found, key, "left").withColumn("found", F.coalesce("found", F.array().cast(f"array<{SPAN}>")))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def pii_report(docs: DataFrame, settings: PiiSettings = PiiSettings()) -> DataFrame:
    """Numbers of base spans by kind, a digest of them, and all spans as text, of each row of docs."""
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    both = F.array_sort(F.concat("base", "found"))
    return find_spans(docs, settings).select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(both).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets.

    The text is cut into regions of CHUNK spans first, so that not every span is looked up from the text's start.
    """

    def region(acc, chunk):
        stop = F.greatest(acc.at, F.array_max(F.transform(chunk, lambda s: s.end)))

        def shown(r):
            def step(now, s):
                piece = F.concat(now.out, F.substr(r.text, now.at - r.at + 1, s.start - now.at), F.lit("<"), F.upper(s.kind), F.lit(">"))
                return F.struct(F.greatest(now.at, s.end).alias("at"), F.when(s.start >= now.at, piece).otherwise(now.out).alias("out"))

            return F.aggregate(chunk, F.struct(r.at.alias("at"), F.lit("").alias("out")), step)

        inner = _let(F.struct(acc.at.alias("at"), F.substr(text, acc.at + 1, stop - acc.at).alias("text")), shown)
        return _let(inner, lambda i: F.struct(i.at.alias("at"), F.concat(acc.out, i.out).alias("out")))

    masked = F.aggregate(_let(spans, _cut), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), region)
    return F.when(F.size(spans) > 0, _let(masked, lambda m: F.concat(m.out, F.substr(text, m.at + 1, F.length(text))))).otherwise(text)


def mask_documents(docs: DataFrame, settings: PiiSettings = PiiSettings()) -> DataFrame:
    """docs with all spans in text masked; all other columns stay as they are, whatever their names. Null text stays null."""
    spans = find_spans(docs, settings).where(F.size("base") + F.size("found") > 0)
    uid, vid, held = (fresh(name, docs.columns) for name in ("pii_uid", "pii_vid", "pii_spans"))
    spans = spans.groupBy("uid", "vid").agg(F.first(F.array_sort(F.concat("base", "found"))).alias(held)).withColumnsRenamed({"uid": uid, "vid": vid}).checkpoint()
    side = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans
    keyed = docs.withColumns(dict(zip((uid, vid), row_key("doc_id", "text"))))
    joined = keyed.join(side, [uid, vid], "left")
    return joined.select(*[mask(joined["text"], F.coalesce(held, F.array().cast(f"array<{SPAN}>"))).alias("text") if c == "text" else joined[c] for c in docs.columns])
