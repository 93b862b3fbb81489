"""Recurring lines by a log-template tree, with DataFrame functions only.

A line is parsed as logs are. Words with digits are variable fields and become ``<*>``. The tree has a fixed depth: its levels are the number of words, the
``LEADING`` words, and a part of the others. For that, the words after the leading ones are dealt into ``PARTS`` parts of ``RUNS`` runs each; a part that several
lines of the same length and leading words share, at the same place, is a node, and a line goes to the node that most lines share (of equals, the first part). A
leaf has one template: at each run what more than half of its lines hold, else a variable, whatever the field (in lines of up to ``LEADING + PARTS * RUNS`` words a run is at most one word). Its
lines are those that agree with all its runs, and it counts if ``CONSTANT`` of its words, or more, are not variable. Above this stand the two plain templates of every line: the line itself,
however short, and the line with its digit fields masked, if half its words are left; lines with fewer left don't go down the tree either.

A template recurs if it stands in two documents or more; its lines stay in the least document and are dropped everywhere else. Lines without words are never dropped.

Counting keeps the least and greatest document of a template, summed up before the shuffle; decisions go back by joins, whose hot
keys Spark splits. Each level of the tree leaves only the lines that may share a template with others for the next. Plain templates are told apart by 128 bits. Runs are compared by 32 bits, within lines that already agree in length, leading words and
a part: where two different runs chance to have one hash, a field is generalised that way. Within one document lines are known by 64 bits. The lines of a document meet again only as its own sorted list of dropped ones, which each line is
looked up in by halving.

Defined cases: null text is the empty text, one empty line; very long texts are read whole, and lines of any length are parsed; a document is what shares a doc_id, null being one id, after all others; lines that
repeat within a document only are kept; of lines whose documents tie none goes; rows that repeat lose the same lines; an empty table gives an empty result; further columns are kept by
:func:`drop_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, materialize, release

LEADING = 2
PARTS, RUNS = 4, 4
#: Least share of a leaf's words that are not variable.
CONSTANT = 0.75
VARIABLE = "<*>"
LAST_ID = (1 << 63) - 1
FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(docs: DataFrame) -> tuple[Column, Column]:
    """What orders a document's rows among all, and what tells its texts apart where they have no id: null ids are one document, but no one group of rows."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)), F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).otherwise(F.lit(0))


def _edges(n: Column) -> list[Column]:
    """Where the runs of a line of n words begin, and where the last one ends."""
    return [(F.lit(LEADING) + F.floor((n - LEADING) * i / (PARTS * RUNS))).cast("int") for i in range(PARTS * RUNS + 1)]


def parsed(docs: DataFrame) -> DataFrame:
    """(d, tie, line, plain, leaf, n, runs): each text's distinct lines as hashes, their plain templates, and of those that go down the tree the first levels (length and leading words), the number of words and hashes of the runs."""
    d, tie = _document(docs)
    each = docs.select(d.alias("d"), tie.alias("tie"), F.explode(F.array_distinct(_lines(F.col("text")))).alias("text"))
    each = each.filter(F.col("text").rlike(WORD))
    digits = F.col("text").rlike("[0-9]")
    words = F.regexp_extract_all(F.when(digits, F.regexp_replace("text", FIELD, VARIABLE)).otherwise(F.col("text")), F.lit(WORD), F.lit(0))
    # What is used several times is an element of an array of one, so that the planner can't copy it into each use.
    counted = F.transform(F.array(F.struct(words.alias("w"), digits.alias("m"))), lambda x: F.struct(x["w"].alias("w"), x["m"].alias("m"), F.size(x["w"]).alias("n"), (~x["m"] | (2 * F.size(F.filter(x["w"], lambda w: w != VARIABLE)) >= F.size(x["w"]))).alias("some")))
    key = lambda kind, x: F.struct(F.xxhash64(F.lit(kind), x).alias("a"), F.xxhash64(x, F.lit(kind)).alias("b"))

    def runs(x: Column) -> Column:
        edges = _edges(x["n"])
        return F.array(*[F.hash(F.slice(x["w"], a + 1, b - a)) for a, b in zip(edges, edges[1:], strict=False)])

    def tree(x: Column) -> Column:
        down = x["some"] & (x["n"] > LEADING + 1)  # with one more word only, lines that share it are the same line
        return F.struct(F.when(x["m"] & x["some"], key("masked", x["w"])).alias("t"), F.when(down, F.xxhash64(x["n"], F.slice(x["w"], 1, LEADING))).alias("leaf"), x["n"].alias("n"), F.when(down, runs(x)).alias("runs"))

    out = each.select("d", "tie", F.xxhash64("text").alias("line"), key("line", F.col("text")).alias("exact"), F.element_at(F.transform(counted, tree), 1).alias("x"))
    return out.select("d", "tie", "line", F.filter(F.array("exact", "x.t"), lambda k: k.isNotNull()).alias("plain"), "x.leaf", "x.n", "x.runs")


def leaves(lists: DataFrame) -> DataFrame:
    """(leaf, runs, first) from (leaf, n, runs, first, last), distinct lists of runs with their least and greatest document: the lists of recurring leaf templates, with the template's least document."""
    parts = F.array(*[F.xxhash64("leaf", F.lit(j), F.slice("runs", j * RUNS + 1, RUNS)) for j in range(PARTS)])
    edges = F.array(*_edges(F.col("n")))
    # Short lines have parts without words, which say nothing.
    nodes = lists.select("leaf", "n", "runs", "first", "last", F.posexplode(parts).alias("j", "node")).filter(F.get(edges, (F.col("j") + 1) * RUNS) > F.get(edges, F.col("j") * RUNS))
    shared = nodes.groupBy("node").agg(F.count("*").alias("c"), F.min("first").alias("f"), F.max("last").alias("l")).filter("c > 1 and f < l").select(F.col("node").alias("s_node"), "c")
    best = nodes.join(shared, F.col("node") == F.col("s_node")).groupBy("leaf", "n", "runs").agg(F.max_by("node", F.struct("c", -F.col("j"))).alias("node"), F.first("first").alias("first"), F.first("last").alias("last"))
    anchored = materialize(best, "anchored")
    members = anchored.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("node").alias("m_node"), "m")
    counts = anchored.select("node", "n", F.posexplode("runs").alias("p", "h")).groupBy("node", "n", "p", "h").agg(F.count("*").alias("c"))
    common = counts.join(members, F.col("node") == F.col("m_node")).filter("2 * c > m")
    held = F.sum(F.get(edges, F.col("p") + 1) - F.get(edges, F.col("p")))
    # A template has at most one word of each run: PARTS x RUNS entries.
    templates = common.groupBy("node", "n").agg(F.collect_list(F.struct("p", "h")).alias("template"), held.alias("held")).filter(F.col("held") + LEADING >= CONSTANT * F.col("n"))
    templates = templates.select(F.col("node").alias("t_node"), "template")
    fits = anchored.join(templates, F.col("node") == F.col("t_node")).filter(F.forall("template", lambda x: F.get(F.col("runs"), x["p"]) == x["h"]))
    fits = materialize(fits.select("node", "leaf", "runs", "first", "last"), "fitting")
    firsts = fits.groupBy("node").agg(F.min("first").alias("f"), F.max("last").alias("l")).filter("f < l").select(F.col("node").alias("f_node"), "f")
    out = materialize(fits.join(firsts, F.col("node") == F.col("f_node")).select("leaf", "runs", F.col("f").alias("first")), "leaves")
    release(anchored, fits)
    return out


def dropped(docs: DataFrame) -> DataFrame:
    """(d, tie, lines): the hashes of the lines that each text loses, sorted."""
    found = materialize(parsed(docs), "lines")
    plain = found.select("d", "tie", "line", F.explode("plain").alias("key"))
    recurring = plain.groupBy("key").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first < last").select(F.col("key").alias("r_key"), "first")
    lost = plain.join(recurring, (F.col("key") == F.col("r_key")) & (F.col("d") > F.col("first"))).select("d", "tie", "line")
    deep = found.filter("leaf is not null").select("d", "tie", "line", "leaf", "n", "runs")
    # The first levels of the tree: where one document or one list of runs stands alone there is nothing to generalise.
    whole = F.xxhash64("runs")
    wide = deep.groupBy("leaf").agg(F.min("d").alias("f"), F.max("d").alias("l"), F.min(whole).alias("a"), F.max(whole).alias("b")).filter("f < l and a < b").select(F.col("leaf").alias("w_leaf"))
    deep = materialize(deep.join(wide, F.col("leaf") == F.col("w_leaf"), "left_semi"), "deep-lines")
    lists = materialize(deep.groupBy("leaf", "n", "runs").agg(F.min("d").alias("first"), F.max("d").alias("last")), "lists")
    general = leaves(lists).select(F.col("leaf").alias("g_leaf"), F.col("runs").alias("g_runs"), "first")
    release(lists)
    more = deep.join(general, (F.col("leaf") == F.col("g_leaf")) & (F.col("runs") == F.col("g_runs")) & (F.col("d") > F.col("first"))).select("d", "tie", "line")
    return lost.unionByName(more).groupBy("d", "tie").agg(F.array_sort(F.collect_set("line")).alias("lines"))


#: Powers of two, greatest first: the steps of a search by halving.
POWERS = [1 << i for i in range(30, -1, -1)]


def _listed(x: Column, ordered: Column) -> Column:
    """Whether ``x`` is in a sorted array, in as many steps as its length has bits."""
    bits = F.length(F.bin(F.size(ordered)))
    steps = F.slice(F.array(*[F.lit(p) for p in POWERS]), F.lit(len(POWERS) + 1) - bits, bits)
    upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(ordered)) & (F.get(ordered, at + step - 1) <= x), at + step).otherwise(at))
    return F.coalesce(F.get(ordered, upto - 1) == x, F.lit(False))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, and __n_lines, __n_dropped."""
    gone = dropped(docs.select("doc_id", "text")).select(F.col("d").alias("__d"), F.col("tie").alias("__tie"), F.col("lines").alias("__lines"))
    d, tie = _document(docs)
    joined = docs.join(gone, (d == gone["__d"]) & (tie == gone["__tie"]), "left")
    every = _lines(F.col("text"))
    kept = F.when(F.col("__lines").isNull(), every).otherwise(F.filter(every, lambda x: ~_listed(F.xxhash64(x), F.col("__lines"))))
    out = joined.withColumn("__kept", kept).withColumn("__n_lines", F.size(every).cast("long")).withColumn("__n_dropped", F.col("__n_lines") - F.size("__kept"))
    return out.withColumn("text", F.array_join("__kept", "\n")).select(*docs.columns, "__n_lines", "__n_dropped")


def query(spark, sf_dir: str) -> DataFrame:
    """op8 over the whole of ``documents``."""
    got = drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, coalesce(doc_id, 9223372036854775807) AS d
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), parsed AS (
  SELECT DISTINCT d, line, regexp_matches(line, '[0-9]') AS m, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS w FROM lines
), sized AS (
  SELECT d, line, m, w, len(w) AS n FROM parsed WHERE len(w) > 0
), plain AS (
  SELECT d, line, 'line' AS kind, [line] AS key FROM sized
  UNION ALL SELECT d, line, 'masked', w FROM sized WHERE m AND 2 * len(list_filter(w, lambda x: x <> '<*>')) >= n
), recurring AS (
  SELECT kind, key, min(d) AS first FROM plain GROUP BY ALL HAVING min(d) < max(d)
), lists AS (
  SELECT w, n, min(d) AS first, max(d) AS last FROM sized WHERE n >= 4 AND 2 * len(list_filter(w, lambda x: x <> '<*>')) >= n GROUP BY w, n
), parts AS (
  SELECT w, n, first, last, j, w[1:2] AS lead, w[2 + (n - 2) * j // 4 + 1:2 + (n - 2) * (j + 1) // 4] AS part,
         [w[2 + (n - 2) * (4 * j + i) // 16 + 1:2 + (n - 2) * (4 * j + i + 1) // 16] for i in range(4)] AS split
  FROM (SELECT *, unnest([0, 1, 2, 3]) AS j FROM lists) WHERE (n - 2) * (j + 1) // 4 > (n - 2) * j // 4
), shared AS (
  SELECT n, lead, j, split, count(*) AS c FROM parts GROUP BY ALL HAVING count(*) > 1 AND min(first) < max(last)
), anchored AS (
  SELECT w, n, first, last, lead, j, split FROM parts JOIN shared USING (n, lead, j, split) QUALIFY row_number() OVER (PARTITION BY w ORDER BY c DESC, j) = 1
), members AS (
  SELECT n, lead, j, split, count(*) AS m FROM anchored GROUP BY ALL HAVING count(*) > 1
), places AS (
  SELECT n, lead, j, split, p, w[2 + (n - 2) * p // 16 + 1:2 + (n - 2) * (p + 1) // 16] AS run FROM (SELECT *, unnest(range(16)) AS p FROM anchored)
), common AS (
  SELECT n, lead, j, split, p, run FROM places JOIN members USING (n, lead, j, split) GROUP BY n, lead, j, split, m, p, run HAVING 2 * count(*) > m
), templates AS (
  SELECT n, lead, j, split, list({'p': p, 'run': run}) AS template FROM common GROUP BY n, lead, j, split HAVING sum(len(run)) + 2 >= 0.75 * n
), fits AS (
  SELECT anchored.* FROM anchored JOIN templates USING (n, lead, j, split)
  WHERE len(list_filter(template, lambda x: w[2 + (n - 2) * x.p // 16 + 1:2 + (n - 2) * (x.p + 1) // 16] <> x.run)) = 0
), leaves AS (
  SELECT w, f AS first FROM fits JOIN (SELECT n, lead, j, split, min(first) AS f FROM fits GROUP BY ALL HAVING min(first) < max(last)) USING (n, lead, j, split)
), lost AS (
  SELECT d, line FROM plain JOIN recurring USING (kind, key) WHERE d > first
  UNION SELECT d, line FROM sized JOIN leaves USING (w) WHERE d > first
)
SELECT lines.doc_id, count(*) AS n_lines, count(lost.line) AS n_dropped,
       length(coalesce(string_agg(lines.line, chr(10) ORDER BY i) FILTER (lost.line IS NULL), '')) AS n_chars,
       sha256(coalesce(string_agg(lines.line, chr(10) ORDER BY i) FILTER (lost.line IS NULL), '')) AS text_sha256
FROM lines LEFT JOIN lost ON lines.d = lost.d AND lines.line = lost.line
GROUP BY lines.doc_id
"""
