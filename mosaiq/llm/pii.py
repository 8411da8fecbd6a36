"""Personal data in texts: base patterns, widened by bootstrapped contextual extraction.

The base patterns give seed entities; long runs of letters and digits are seeds of a kind of their
own, secrets. The one or two words beside identifier-like tokens are lexical patterns; pattern and
instance scores pass over the pattern-instance graph in rounds, starting at the seeds. Runs of such
tokens that patterns of high confidence name are added. All of it is DataFrame expressions:
`split` at a pattern gives the gaps between matches, whose lengths give the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.llm.common import row_key
from mosaiq.scratch import Scratch

#: The kinds in their order, and their patterns. Possessive forms and looks behind match
#: the same as the plain ones, in linear time: a match can start only where a run starts or the last match ended.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Keys and tokens of services: 32 or more letters, digits, - or _, with a letter and a digit.
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{32,}+"
#: Identifier-like tokens: words with a digit or @, without the punctuation around them.
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D]++"
#: A pattern needs seeds of a kind in so many distinct documents, and such a score; rounds over the graph.
MIN_SUPPORT, MIN_SCORE, ROUNDS = 5, 0.9, 3
#: A hot pattern's edges are dealt to so many tasks.
SALTS = 16
#: Matches summed at a time.
CHUNK = 64


def _sums(lengths: Column) -> Column:
    """Sums over the entries before each entry. Chunks keep the copying of growing arrays small."""
    add = lambda acc, x: acc + x
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    before = lambda xs: F.slice(F.aggregate(xs, F.array(F.lit(0)), grow), 1, F.size(xs))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(lengths) / CHUNK).cast("int") - 1)), lambda c: F.slice(lengths, c * CHUNK + 1, CHUNK))
    at = before(F.transform(chunks, lambda xs: F.aggregate(xs, F.lit(0), add)))
    return F.flatten(F.zip_with(chunks, at, lambda xs, a: F.transform(before(xs), lambda x: x + a)))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, left, right>> of the matches of a pattern that never matches empty text."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.transform(found, lambda m, i: F.struct(m.alias("match"), F.get(gaps, i).alias("left"), F.get(gaps, i + 1).alias("right")))
    at = _sums(F.transform(parts, lambda p: F.length(p["left"]) + F.length(p["match"])))
    start = lambda p, a: a + F.length(p["left"])
    return F.zip_with(parts, at, lambda p, a: F.struct(start(p, a).alias("start"), (start(p, a) + F.length(p["match"])).alias("end"), p["match"].alias("match"), p["left"].alias("left"), p["right"].alias("right")))


def _kept(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the base patterns, in order; a match that fails its test is dropped."""
    empty = F.array().cast("array<struct<start:int,end:int,match:string,left:string,right:string>>")
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": F.contains(text, F.lit("+"))}

    def of(i: int, kind: str, pattern: str) -> Column:
        some = F.when(needs[kind], spans(text, pattern)).otherwise(empty)
        some = F.filter(some, lambda s: _kept(kind, s["match"]))
        return F.transform(some, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*[of(i, *x) for i, x in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))]))


def count_kind(found: Column, kind: str) -> Column:
    i = KINDS.index(kind)
    return F.size(F.filter(found, lambda s: s["kind"] == i)).cast("long")


def _tokens(text: Column) -> Column:
    """Identifier-like pieces with their trimmed bounds, the word on each side, and whether only blanks part one from the piece before or punctuation ends it."""
    edge = r"^[\"'(\[<{,;:.!?]+|[\"')\]>},;:.!?]+$"
    lead = lambda m: F.length(m) - F.length(F.regexp_replace(m, r"^[\"'(\[<{,;:.!?]+", ""))
    left = lambda g: F.regexp_extract(g, r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$", 1)
    ahead = lambda g: F.regexp_extract(g, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
    left2 = lambda g: F.regexp_extract(g, r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+$", 1)
    ahead2 = lambda g: F.regexp_extract(g, r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]++[\x20\x09-\x0D]++([^\x20\x09-\x0D]+)", 1)
    goes_on = lambda s: s["left"].rlike(r"^[\x20\x09]+$")
    ends = lambda m: m.rlike(r"[\"',;:.!?]$")
    return F.transform(spans(text, TOKEN), lambda s: F.struct((s["start"] + lead(s["match"])).alias("start"), (s["start"] + lead(s["match"]) + F.length(F.regexp_replace(s["match"], edge, ""))).alias("end"), F.regexp_replace(s["match"], edge, "").alias("token"), F.lower(left(s["left"])).alias("left"), F.lower(ahead(s["right"])).alias("right"), F.lower(left2(s["left"])).alias("left2"), F.lower(ahead2(s["right"])).alias("right2"), goes_on(s).alias("goes_on"), ends(s["match"]).alias("ends")))


def _facts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    t = F.coalesce(docs[text], F.lit(""))
    df = docs.select(docs[doc_id].alias("doc_id"), row_key(docs[doc_id], docs[text]).alias("key"), t.alias("_t"))
    df = df.withColumn("_any", F.col("_t").rlike("[0-9@]"))
    none, bare = F.array().cast("array<struct<start:int,kind:int,end:int>>"), F.array().cast("array<struct<start:int,end:int,token:string,left:string,right:string,left2:string,right2:string,goes_on:boolean,ends:boolean>>")
    secrets = F.transform(spans(F.col("_t"), SECRET), lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    return df.select("doc_id", "key", F.when(F.col("_any"), base_spans(F.col("_t"))).otherwise(none).alias("base"), F.when(F.col("_t").rlike(SECRET), secrets).otherwise(none).alias("secrets"), F.when(F.col("_any"), _tokens(F.col("_t"))).otherwise(bare).alias("tokens"))


def _instances(facts: DataFrame) -> DataFrame:
    """(key, start, end, token, left, right, left2, right2, seed): the pieces of a base span or secret, or a run of pieces outside them that only blanks part."""
    t = facts.where(F.size("tokens") > 0).select("key", F.concat("base", "secrets").alias("seeds"), F.posexplode("tokens").alias("pos", "t")).dropDuplicates(["key", "pos"])
    over = F.filter("seeds", lambda s: (s["start"] < F.col("t.end")) & (s["end"] > F.col("t.start")))
    t = t.select("key", "pos", "t.*", F.get(over, 0).alias("span"))
    order = W.partitionBy("key").orderBy("pos")
    alone = F.col("span").isNull() & (~F.col("goes_on") | F.lag("ends").over(order))
    starts = F.lag("pos").over(order).isNull() | alone | ~F.col("span").eqNullSafe(F.lag("span").over(order))
    t = t.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("run", F.sum("starts").over(order))
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    runs = t.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.lower(pieces).alias("token"), *[F.min_by(c, "pos").alias(c) for c in ("left", "left2")], *[F.max_by(c, "pos").alias(c) for c in ("right", "right2")], F.coalesce(F.first("span")["kind"], F.lit(-1)).alias("seed"))
    return runs.drop("run").where("token <> ''")


def _bootstrap(facts: DataFrame, cuts: Scratch) -> DataFrame:
    """(key, start, end, kind) of runs of identifier-like pieces outside the base spans that high-confidence patterns name.

    A pattern is the word, or the two words, left or right of an instance (a base span, a secret or a
    run), or the word on either side. It needs seeds of a kind in MIN_SUPPORT distinct documents. Its
    score for the kind is the mean score of the distinct instances (by text) it stands beside; an
    instance that is a seed of the kind scores 1, one of another kind 0 (but a secret is free to be of
    the base kinds), any other the best score among its patterns in the round before.
    """
    t = _instances(facts)
    sides = {"l": ["left"], "r": ["right"], "b": ["left", "right"], "ll": ["left2", "left"], "rr": ["right", "right2"]}
    pats = F.array(*[F.when(F.length(cs[-1 if k == "rr" else 0]) > 0, F.concat(F.lit(f"{k}:"), F.concat_ws(" ", *cs))) for k, cs in sides.items()])
    word = r"^(l|r|ll|rr):.*\p{L}|^b:.*\p{L}.* .*\p{L}"
    uses = t.withColumn("pattern", F.explode(F.filter(pats, lambda p: p.isNotNull() & p.rlike(word)))).drop("left", "right", "left2", "right2")
    uses = cuts.cut(uses.withColumn("salt", F.pmod(F.xxhash64("token"), F.lit(SALTS)).cast("int")), "uses")
    able = uses.where("seed >= 0").select("pattern", F.col("seed").alias("kind"), "key").distinct().groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= MIN_SUPPORT).drop("docs")
    able = cuts.cut(able.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "able")
    edges = uses.groupBy("pattern", "token", "salt").agg(F.max("seed").alias("seed"))
    edges = cuts.cut(edges.join(able, ["pattern", "salt"]), "edges")
    own = F.when(F.col("seed") == F.col("kind"), 1.0).otherwise(0.0)
    # Nobody's seed, or a secret where another kind is asked for.
    free = (F.col("seed") < 0) | (F.col("seed") == len(KINDS)) & (F.col("kind") < len(KINDS))
    scored = edges.withColumn("score", own)
    patterns = None
    for r in range(ROUNDS):
        patterns = scored.groupBy("pattern", "kind").agg(F.avg("score").alias("score")).where("score > 0.5")
        patterns = cuts.cut(patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), f"patterns{r % 2}")
        if r + 1 == ROUNDS:
            break
        best = edges.where(free).join(patterns, ["pattern", "kind", "salt"]).groupBy("token", "kind").agg(F.max("score").alias("best"))
        scored = edges.join(best, ["token", "kind"], "left").withColumn("score", F.when(free, F.coalesce("best", F.lit(0.0))).otherwise(own))
    sure = patterns.where(F.col("score") >= MIN_SCORE)
    new = uses.where(f"seed < 0 or seed = {len(KINDS)}").join(sure, ["pattern", "salt"]).where(free)
    return new.groupBy("key", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("k")))["k"].alias("k")).select("key", "start", "end", (-F.col("k")).alias("kind"))


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base, spans and secrets (array<struct<start, kind, end>>) of every row.

    kind is a place in KINDS in base and spans; secrets, seeds and added ones, are of the kind after them.
    Positions count code points, the end is exclusive, and spans stand in the order of start, then
    kind. Null texts are empty. Rows that repeat id and text get the same spans. Added spans never
    overlap base spans; a secret may be named as a span too. Other columns are not read, whatever their names; an empty table
    gives no rows.
    """
    cuts = Scratch(docs.sparkSession, "pii")
    facts = cuts.cut(_facts(docs, text, doc_id), "facts")
    new = _bootstrap(facts, cuts).groupBy("key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    out = facts.drop("tokens").join(new, "key", "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    secret = lambda x: x["kind"] == len(KINDS)
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.filter("more", lambda x: ~secret(x)))).alias("spans"), F.array_sort(F.concat("secrets", F.filter("more", secret))).alias("secrets"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
