"""Operator 12: spelling variants by an even-partition pigeonhole join.

A word and one that is equally long or one longer, with one edit between them, agree in one of two even parts: the edit lies in the other.
So every word stands in an index under each part (for its length), and asks with the parts that words of equal or one smaller length would
have, shifted where the ask is longer. Each part is written as the word with the region of the other part cut out; a region is a path of
halvings. Where many words share a part, the region is halved again (and again), so that no crowd is compared pair by pair: a pair meets
under the half that holds its edit, and a region of a single place leaves true neighbours only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import discard, ship, stage, table

RUN = r"[A-Za-zÀ-ÿ]+"
#: Pairs of an index word and an asking word under one part that are compared; a part with more is halved.
CROWD = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, run): the letter runs of each text, only A-Z lower-cased; none of null texts."""
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    return docs.select(F.col(id_col), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), 0)).alias("run"))


def slips(found: DataFrame, id_col: str = "doc_id", every: int = 31) -> DataFrame:
    """runs with ``word``: the run, less one code point where the crc32 of '<id>:<run>' divides by ``every``; a null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.expr("cast(_h % length(run) as int)")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.withColumn("_h", h).withColumn("word", F.when(F.col("_h") % every == 0, cut).otherwise(F.col("run"))).drop("_h")


def vocabulary(words: DataFrame, least_chars: int = 7, least: int = 2) -> DataFrame:
    """(word, n): distinct words of at least so many characters, with at least so many occurrences."""
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _cut(word: Column, lo: Column, hi: Column) -> Column:
    """word without its characters from lo to hi (from 0, hi left out), both sides kept apart."""
    return F.concat_ws("\x00", F.substring(word, F.lit(1), lo.cast("int")), F.substring(word, (hi + 1).cast("int"), F.length(word)))


def _keyed(entries: DataFrame) -> DataFrame:
    """Entries with their key: the longer ask's region is one character wider than the index word's."""
    longer = (F.col("side") == "ask").cast("int")
    rest = _cut(F.col("word"), F.col("lo"), F.col("hi") + longer)
    return entries.withColumn("key", F.xxhash64("kind", F.length("word") - longer, "lo", "hi", rest))


def _halves(entries: DataFrame) -> DataFrame:
    """Each entry with either half of its region. An even region of an equally long word ends at one place; that of an index word and a longer
    ask ends between two characters."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(F.col("lo").alias("a"), F.col("mid").alias("b")), F.struct(F.col("mid").alias("a"), F.col("hi").alias("b")))
    # A single character and the places before and behind it: the ask's additional character stands at one of the two.
    single = F.array(F.struct(F.col("lo").alias("a"), F.col("lo").alias("b")), F.struct(F.col("hi").alias("a"), F.col("hi").alias("b")))
    both = F.when(F.col("hi") - F.col("lo") == 1, single).otherwise(parts)
    return _keyed(entries.withColumn("mid", middle).withColumn("_p", F.explode(both)).select("word", "kind", "side", F.col("_p.a").alias("lo"), F.col("_p.b").alias("hi")))


def _entries(words: DataFrame) -> DataFrame:
    """Index and asking entries of all words at the first halving: kind E for equally long words, which index and ask alike, and L for an index
    word and a longer ask."""
    roles = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("side"), (F.length("word") - c).alias("len")) for k, s, c in (("E", "both", 0), ("L", "index", 0), ("L", "ask", 1))))
    whole = words.select("word", F.explode(roles).alias("r")).select("word", "r.kind", "r.side", F.lit(0).alias("lo"), F.col("r.len").alias("hi"))
    # What is too short for halves stands under its whole region: single characters, and the empty word with those one longer.
    least = F.when(F.col("kind") == "E", 1).otherwise(0)
    return _keyed(whole.where(F.col("hi") == least)).unionByName(_halves(whole.where(F.col("hi") > least)))


def _met(entries: DataFrame) -> DataFrame:
    """(a, b): words under one key with one edit between them, each pair in one order."""
    left = entries.where("side <> 'ask'").select("key", F.col("word").alias("a"), "kind")
    right = entries.where("side <> 'index'").select("key", F.col("word").alias("b"), F.col("kind").alias("_k"))
    near = F.expr("levenshtein(a, b, 1) = 1") & F.when(F.col("kind") == "E", (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))).otherwise(F.length("b") == F.length("a") + 1)
    return left.join(right, (left["key"] == right["key"]) & (F.col("kind") == F.col("_k")) & near).select("a", "b")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): all pairs of words (a table with the distinct column word) that differ by exactly one inserted, deleted or replaced character,
    each once. Nulls have no partner. Parts with more than ``crowd`` pairs are halved until they are small or hold neighbours only; each
    halving is a round, written to the shared folder, and only crowds go on."""
    open_, found, used = stage(_entries(words.where("word IS NOT NULL")), "word-parts"), [], []
    while True:
        used.append(open_)
        index, asks = F.count_if(F.col("side") != "ask"), F.count_if(F.col("side") != "index")
        done = (F.col("kind") == "E") & (F.col("hi") - F.col("lo") <= 1) | (F.col("hi") == F.col("lo"))
        sizes = open_.where(~done).groupBy("key").agg((index * asks).alias("pairs"), F.count(F.lit(1)).alias("rows"))
        crowded = stage(sizes.where(F.col("pairs") > crowd).select("key", "rows"), "crowded")
        used.append(crowded)
        if crowded.isEmpty():
            found.append(_met(open_))
            break
        tagged = stage(_tag(open_, crowded), "tagged-parts")
        used.append(tagged)
        found.append(_met(tagged.where("NOT crowd").drop("crowd")))
        open_ = stage(_halves(tagged.where("crowd")), "word-parts")
    pairs = stage(reduce(DataFrame.unionByName, found).distinct(), "near-words")
    discard(*used)
    return pairs


def _tag(entries: DataFrame, crowded: DataFrame) -> DataFrame:
    """entries with crowd: whether their key is in the table. Keys of over a thousandth of its rows, under a thousand, are broadcast."""
    total = crowded.agg(F.sum("rows")).first()[0]
    hot = crowded.where(F.col("rows") * 1000 > total).select("key", F.lit(True).alias("_hot"))
    met = entries.join(F.broadcast(hot), "key", "left")
    cold = crowded.where(F.col("rows") * 1000 <= total).select("key", F.lit(True).alias("_cold"))
    spread = met.where("_hot IS NULL").join(cold, "key", "left").withColumn("crowd", F.coalesce("_cold", F.lit(False))).drop("_cold", "_hot")
    return spread.unionByName(met.where("_hot").withColumn("crowd", F.lit(True)).drop("_hot"))


def group_variants(words: DataFrame, times: int = 10, crowd: int = CROWD) -> DataFrame:
    """words (word, n; distinct) -> word, n, n_near, form, form_n, root.

    form is the near word of largest n (ties: the smaller in code-point order) if its n is at least ``times`` (2 or more) the word's, else
    null, form_n its n; root is the end of the chain of forms, the word itself without any. As n grows by ``times`` with each step, chains
    are short, and pointers that double reach the end in a number of rounds known beforehand. Null words are left out; an empty table gives
    an empty result.
    """
    counted = stage(words.where("word IS NOT NULL").select("word", "n"), "words")
    pairs = near_words(counted, crowd)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partner = counted.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = both.join(partner, "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), "b")).alias("_best"))
    enough = -F.col("_best.m") >= times * F.col("n")
    formed = counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("_best.b")).alias("form"), F.when(enough, -F.col("_best.m")).alias("form_n"))
    formed = stage(formed, "forms")
    steps, most = 1, counted.agg(F.max("n")).first()[0] or 1
    while times**steps <= most:
        steps += 1
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = stage(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        reach *= 2
    return formed.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    words = vocabulary(slips(runs(table(spark, sf_dir, "documents"))))
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 by its table, as the SQL engine has none; near words by the deletions that they share.
OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) AS t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END)) AS bytes FROM d),
h AS (SELECT doc_id, run, n, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) AS h FROM b, crc),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, p, substring(word, 1, p - 1) || substring(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
pairs AS (SELECT DISTINCT a, b FROM (
  SELECT i.word AS a, j.word AS b FROM x AS i JOIN x AS j ON i.rest = j.rest AND i.p = j.p AND i.word <> j.word
  UNION ALL SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word
  UNION ALL SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word)),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, b)) AS b, max(v.n) AS b_n FROM pairs JOIN v ON v.word = b GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 10 * v.n THEN b END AS form, CASE WHEN b_n >= 10 * v.n THEN b_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, coalesce(form, word) AS at, form IS NOT NULL AS more FROM f
  UNION ALL SELECT walk.word, coalesce(f.form, f.word), f.form IS NOT NULL FROM walk JOIN f ON f.word = walk.at WHERE walk.more)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND NOT walk.more
"""
