"""Spelling variants: words one edit apart, found by a relational trie frontier.

``word_counts`` reads the words of whole texts. ``near_pairs`` finds all pairs that differ by
one inserted, deleted or replaced code point:

* The words, each with an end mark, stand in a trie, and reversed in a second one. With one edit, a
  word agrees with its near word on its first half or on its last half, so a state of no
  edits starts at half of the word's own path, where nodes are small.
* ``trie_edges`` is the distributed edge table. It holds the edges of nodes that branch: the hash
  of the path up to and with the edge's letter, and the least and greatest word below,
  whose common beginning is the path to the next node that branches (so a chain of
  single letters is one step, however long a word is).
* States are (word, position, node, edits). The states of no edits lie on the word's own path
  and are joined with all edges of their node: an edge with another letter takes the one edit,
  as a replacement by a greater letter or as an insertion (from the other
  word's side the same pairs are a smaller letter or a deletion).
* A state of one edit has one way left. Level by level it is joined with the edge of its next
  letter and goes on while the wanted word lies between the least and the greatest one
  below. At an edge with one word it has arrived, and the two words are neighbours.

The edge table is bucketed by the edge's hash, so that a level moves its states alone. Hash
collisions add states but no pairs: the last step compares whole words. A node that very many words pass is
one key of joins whose other side has one row a node (at most one edge a letter); adaptive
execution splits its words.

Rows: null texts have no words, a null id counts as empty text in ``<id>:<word>``; repeated rows
count again. An empty table has no words. Ties of the form go to the smallest
word by code points. Other columns are not read.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import materialize_table

#: The letters of words, the least length and count of a word, the share
#: of runs that lose a letter, and how much more often a form is used.
LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS = 7
MIN_COUNT = 2
DROP_ONE_IN = 31
FORM_RATIO = 10
#: End mark of a word in the tries; no letter.
END = "|"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the distinct words of all texts with at least ``MIN_CHARS`` code points and ``MIN_COUNT`` uses."""
    # A run that is long enough is matched whole; shorter ones cannot become words.
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_doc"), F.explode(
        F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{MIN_CHARS},}}"), F.lit(0))).alias("_run"))
    run = F.translate("_run", string.ascii_uppercase, string.ascii_lowercase)
    runs = runs.select("_doc", run.alias("_run"))
    h = F.crc32(F.concat(F.col("_doc"), F.lit(":"), F.col("_run")).cast("binary"))
    at = (h % F.length("_run")).cast("int")
    short = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    word = F.when(h % DROP_ONE_IN == 0, short).otherwise(F.col("_run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_CHARS))


def _path(way: Column, text: Column, chars: Column) -> Column:
    """The hash that names the path of the first ``chars`` letters."""
    return F.xxhash64(way, F.substring(text, F.lit(1), chars))


def _paths(words: DataFrame) -> DataFrame:
    """The nodes on the second half of each word's path, in both tries.

    way (0 forward, 1 reversed), s (word and end mark), n, pos, node.
    """
    both = words.select("n", F.explode(F.array(
        F.struct(F.lit(0).alias("way"), F.concat("word", F.lit(END)).alias("s")),
        F.struct(F.lit(1).alias("way"), F.concat(F.reverse("word"), F.lit(END)).alias("s")))).alias("t")).select("n", "t.*")
    length = F.length("s") - 1
    # A near word may be one letter longer, so it stands one place earlier than its own half.
    start = F.ceil((length - 2) / 2).cast("int")
    rows = both.select("way", "s", "n", F.explode(F.sequence(start, length)).alias("pos"))
    return rows.withColumn("node", _path(F.col("way"), F.col("s"), F.col("pos")))


def _branching(words: DataFrame) -> DataFrame:
    """The paths' nodes that have more than one edge, as a table."""
    paths = _paths(words)
    letter = F.substring("s", F.col("pos") + 1, F.lit(1))
    nodes = paths.groupBy("node").agg(F.min(F.ascii(letter)).alias("_lo"), F.max(F.ascii(letter)).alias("_hi")) \
        .where("_lo <> _hi").select("node")
    return materialize_table(paths.join(nodes, "node", "left_semi"))


def trie_edges(rows: DataFrame) -> DataFrame:
    """The edges of branching nodes: node, edge (hash), letter, lo, hi (least and greatest word below), n, upto.

    ``upto`` is the length of the way that lo and hi share; n the count of the word if it is one.
    """
    edge = _path(F.col("way"), F.col("s"), F.col("pos") + 1)
    found = rows.withColumn("edge", edge).groupBy("edge").agg(
        F.min("node").alias("node"), F.min("pos").alias("_pos"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.min("n").alias("n"))
    same = F.expr("array_position(zip_with(split(lo, ''), split(hi, ''), (a, b) -> a = b), false)")
    return found.select("edge", "node", F.substring("lo", F.col("_pos") + 1, F.lit(1)).alias("letter"), "lo",
                        F.when(F.col("hi") > F.col("lo"), F.col("hi")).alias("hi"), "n",
                        F.when(F.col("hi") > F.col("lo"), same.cast("int") - 1).alias("upto"))


def _bucketed(edges: DataFrame) -> tuple[DataFrame, str]:
    """The edges as a table in buckets by edge, under the shared checkpoint folder."""
    spark = edges.sparkSession
    name = f"trie_edges_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges.repartition(buckets, "edge").write.option("path", f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}") \
        .bucketBy(buckets, "edge").sortBy("edge").format("parquet").saveAsTable(name)
    return spark.table(name), name


def _below(states: DataFrame) -> DataFrame:
    """States whose wanted word may lie below their edge (the least and greatest word are its bounds)."""
    return states.where((F.col("want") >= F.col("lo")) & (F.col("want") <= F.coalesce("hi", "lo")))


STATE = ["way", "s", "n", "want"]


def _with_one_edit(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The states of no edits, joined with the other edges of their nodes: states of one edit."""
    nodes = edges.groupBy("node").agg(F.collect_list(F.struct("letter", "lo", "hi", F.col("n").alias("m"), "upto")).alias("edges"))
    length = F.length("s") - 1
    here = rows.where(F.col("pos") >= F.ceil((length - 1) / 2))
    own = F.substring("s", F.col("pos") + 1, F.lit(1))
    tried = here.join(nodes, "node").select(
        "way", "s", "n", own.alias("_own"), F.substring("s", F.lit(1), F.col("pos")).alias("_head"),
        F.substring("s", F.col("pos") + 1, length + 1).alias("_tail"), F.explode("edges").alias("e"))
    tried = tried.where((F.col("e.letter") != END) & (F.col("e.letter") != F.col("_own")))
    head = F.concat("_head", F.col("e.letter"))
    inserted = F.concat(head, F.col("_tail"))
    replaced = F.when((F.col("_own") != END) & (F.col("e.letter") > F.col("_own")),
                      F.concat(head, F.substring("_tail", F.lit(2), F.length("_tail"))))
    states = tried.select("way", "s", "n", "e.lo", "e.hi", "e.m", "e.upto", F.explode(F.array(inserted, replaced)).alias("want"))
    return _below(states).select(*STATE, "lo", "hi", "m", "upto")


def _arrived(states: DataFrame) -> DataFrame:
    """Pairs of the states at an edge with one word; that word lies between its own bounds, so it is the wanted one."""
    plain = [F.substring(c, F.lit(1), F.length(c) - 1) for c in ("s", "want")]
    return states.where(F.col("hi").isNull() & (F.col("want") == F.col("lo"))).select(
        *[F.when(F.col("way") == 0, p).otherwise(F.reverse(p)).alias(x) for p, x in zip(plain, ("a", "b"))],
        F.col("n").alias("n_a"), F.col("m").alias("n_b"))


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of ``words`` (word, n) one edit apart, each once: a, b, n_a, n_b."""
    spark = words.sparkSession
    rows = _branching(words)
    edges, name = _bucketed(trie_edges(rows))
    try:
        states = materialize_table(_with_one_edit(rows, edges))
        found = [_arrived(states)]
        while True:
            going = states.where(F.col("hi").isNotNull())
            if going.isEmpty():
                break
            going = going.select(*STATE, _path(F.col("way"), F.col("want"), F.col("upto") + 1).alias("edge"))
            step = edges.select("edge", "lo", "hi", F.col("n").alias("m"), "upto")
            states = materialize_table(_below(going.join(step, "edge")).select(*STATE, "lo", "hi", "m", "upto"))
            found.append(_arrived(states))
        pairs = found[0]
        for f in found[1:]:
            pairs = pairs.unionByName(f)
        return materialize_table(pairs.distinct())
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the catalog's entry


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word with a form along the forms to the last (by doubling; counts grow, so no way is a circle)."""
    at = materialize_table(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = materialize_table(at.join(on, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if at.where("_moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """Per word: form, root, n, n_near, form_n (see the module)."""
    words = materialize_table(words)
    pairs = near_pairs(words)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_a").alias("n"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_b").alias("n"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("_b"),
                                     F.min("n").alias("_n"))
    used = -F.col("_b.k") >= FORM_RATIO * F.col("_n")
    best = materialize_table(best.select("word", "n_near", F.when(used, F.col("_b.near")).alias("form"), F.when(used, -F.col("_b.k")).alias("form_n")))
    ends = roots(best.where(F.col("form").isNotNull()))
    return words.join(best, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return variants(word_counts(docs, id_col, text_col))


#: The same by deletion: two words are one replacement apart if they are equal without the
#: letter at one place, one insertion apart if one is the other without a letter.
ORACLE = """
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per_doc AS (SELECT doc, run, count(*) AS uses FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, uses, xor(list_reduce(list_prepend(4294967295::BIGINT,
      flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
        ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64]::BIGINT[] END))),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda v, z: xor(v // 2, (v % 2) * 3988292384))), 4294967295) AS h FROM per_doc),
spelled AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, uses FROM hashed),
words AS (SELECT word, sum(uses)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(uses) >= 2),
cut AS (SELECT word, n, p, word[:p] || word[p + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n, a.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n, w.n FROM words w JOIN cut c ON c.rest = w.word
  UNION SELECT c.word, w.word, w.n, c.n FROM words w JOIN cut c ON c.rest = w.word),
counted AS (SELECT word, count(DISTINCT near) AS n_near FROM near GROUP BY word),
best AS (SELECT word, near AS form, near_n AS form_n FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1 AND near_n >= 10 * n),
follow AS (
  SELECT word, form AS root, 1 AS step FROM best
  UNION ALL SELECT f.word, b.form, f.step + 1 FROM follow f JOIN best b ON b.word = f.root),
ends AS (SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word)
SELECT w.word, b.form, coalesce(e.root, w.word) AS root, w.n, coalesce(c.n_near, 0)::BIGINT AS n_near, b.form_n
FROM words w LEFT JOIN counted c USING (word) LEFT JOIN best b USING (word) LEFT JOIN ends e USING (word)
"""
