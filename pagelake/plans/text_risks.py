"""Queries of text risks and keys over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.operators import measures as M
from pagelake.operators import tables
from pagelake.session import table

QUERIES, ORACLES = {}, {}
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_RUN = "regexp_matches(text, '" + "|".join(f"[{c}{c.upper()}]{{4}}" for c in LETTERS) + "')"


@query(f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty_content' ELSE '' END AS empty, {_RUN} AS runs FROM documents WHERE {_RUN} OR trim(text) = ''")
def doc_character_runs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    empty = F.trim("text") == ""
    return d.filter(T.has_character_run(F.col("text")) | empty).select("doc_id", F.when(empty, "empty_content").otherwise("").alias("empty"), T.has_character_run(F.col("text")).alias("runs"))


@query()
def doc_text_risks(spark, sf_dir):
    """The reasons for review of each document, in their order; rows without a reason are left out."""
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    flags = (("empty_content", F.trim(t) == ""), ("repeated_text", T.repeats_phrase(t)), ("tail_repetition", T.repeats_tail(t)), ("repeated_suffix", T.repeats_suffix(t)), ("character_repetition", T.has_character_run(t)), ("invalid_calendar_date", T.impossible_date(t)))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags]))
    return d.select("doc_id", F.array_join(reasons, ",").alias("risks"), F.size(reasons).cast("long").alias("n_risks")).filter("n_risks > 0")


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '12 34 O 56' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || ' 7' WHEN 2 THEN 'no ' || o_orderkey || ' l 5' ELSE '1 B 2' END AS t FROM orders),
w AS (SELECT o_orderkey, regexp_extract_all(t, '[\\p{L}\\p{N}]+') AS a FROM o)
SELECT o_orderkey FROM w WHERE len([x FOR x IN a IF regexp_full_match(x, '[0-9]+')]) >= 2 AND 2 * len([x FOR x IN a IF regexp_full_match(x, '[0-9]+')]) >= len(a)
AND len([i FOR i IN range(1, len(a)) IF (regexp_full_match(a[i], '\\p{L}') AND regexp_full_match(a[i + 1], '[0-9]+')) OR (regexp_full_match(a[i], '[0-9]+') AND regexp_full_match(a[i + 1], '\\p{L}'))]) > 0""".replace("\\\\", "\\"))
def letter_among_digits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, F.lit("12 34 O 56")).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(" 7"))).when(k % 4 == 2, F.concat(F.lit("no "), k.cast("string"), F.lit(" l 5"))).otherwise(F.lit("1 B 2"))
    return o.select("o_orderkey", t.alias("t")).filter(T.letter_among_digits(F.col("t"))).select("o_orderkey")


@query("""WITH g AS (SELECT sha256(text) AS h, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1)
SELECT d.doc_id, g.first_id AS duplicate_of FROM documents d JOIN g ON sha256(d.text) = g.h WHERE d.doc_id <> g.first_id""")
def exact_duplicates(spark, sf_dir):
    return M.first_seen(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9%$]+')) AS token FROM documents)
SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 5""")
def token_multiset(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9%$]+"), F.lit(0))).alias("token"))
    return d.groupBy("doc_id", "token").agg(F.count("*").alias("n")).filter("n >= 5")


@query("""WITH a AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9%$]+')) AS token FROM benchmark), x AS (SELECT item_id, token, count(*) AS n FROM a GROUP BY ALL),
b AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9%$]+')) AS token FROM documents), y AS (SELECT doc_id, token, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT item_id, sum(n) AS size FROM x GROUP BY 1), c AS (SELECT item_id, doc_id, sum(least(x.n, y.n)) AS inside FROM x JOIN y USING (token) GROUP BY ALL)
SELECT item_id, doc_id, CAST(inside AS BIGINT) AS inside FROM c JOIN s USING (item_id) WHERE inside >= 0.8 * size""")
def token_coverage(spark, sf_dir):
    """Documents that hold at least four fifths of a benchmark passage's tokens, as multisets."""

    def counts(name, key):
        words = table(spark, sf_dir, name).select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9%$]+"), F.lit(0))).alias("token"))
        return words.groupBy(key, "token").agg(F.count("*").alias("n"))

    x, y = counts("benchmark", "item_id"), counts("documents", "doc_id").withColumnRenamed("n", "m")
    # a document without any of a passage's rarest tokens that make up more than a fifth of it cannot hold four fifths
    known = y.groupBy("token").agg(F.count("*").alias("documents"))
    rarest = Window.partitionBy("item_id").orderBy(F.coalesce("documents", F.lit(0)), "token")
    ranked = x.join(known, "token", "left").withColumn("upto", F.sum("n").over(rarest.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = x.groupBy("item_id").agg(F.sum("n").alias("size"))
    rare = ranked.join(sizes, "item_id").filter("upto - n <= 0.2D * size").select("item_id", "token")
    candidates = rare.join(y.select("token", "doc_id"), "token").select("item_id", "doc_id").distinct()
    both = candidates.join(x, "item_id").join(y, ["doc_id", "token"])
    inside = both.groupBy("item_id", "doc_id").agg(F.sum(F.least("n", "m")).alias("inside"))
    return inside.join(sizes, "item_id").filter("inside >= 0.8D * size").select("item_id", "doc_id", "inside")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def snippet_recovery(spark, sf_dir):
    """Benchmark passages that occur verbatim: candidates meet by up to six words inside the passage, then the whole passage is looked for.

    A passage's first and last word may be parts of a document's words, so the key leaves them out; a passage without a word
    between them is looked for in every document, block by block."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    b = table(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", F.col("text").alias("passage"), words(F.col("text")).alias("w"))
    short = b.filter("size(w) < 3").select("item_id", "passage")
    b = b.filter("size(w) > 2").withColumn("key", F.slice("w", 2, F.least(F.size("w") - 2, F.lit(6))))
    b = b.select("item_id", "passage", F.size("key").alias("long"), F.array_join("key", " ").alias("key"))
    texts = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    d = texts.withColumn("w", words(F.col("text"))).join(F.broadcast(b.select("long").distinct()), F.size("w") >= F.col("long"))
    keys = d.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("long") + 1), lambda i: F.array_join(F.slice("w", i, F.col("long")), " ")))).alias("key"))
    pairs = keys.join(b.select("item_id", "key"), "key").select("item_id", "doc_id").distinct()
    found = pairs.join(b.select("item_id", "passage"), "item_id").join(texts, "doc_id").filter(F.contains("text", "passage")).select("item_id", "doc_id")
    return found.unionByName(texts.join(short.hint("shuffle_replicate_nl"), F.contains("text", "passage")).select("item_id", "doc_id"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, line FROM l WHERE length(line) >= 40)
SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS n FROM t GROUP BY line HAVING count(*) > 3""")
def repeated_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 40)
    return lines.groupBy("line").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("n")).filter("n > 3")


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, 'href="[^"]*"')) AS BIGINT) AS links FROM pages""")
def page_titles_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="[^"]*"'), F.lit(0))).cast("long").alias("links"))


@query("""SELECT l_orderkey, CAST(count(*) + 1 AS INT) AS row_count, 3 AS column_count, CAST(0 AS BIGINT) AS overlaps, CAST(CASE WHEN l_orderkey % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS gaps, l_orderkey % 3 <> 1 AS valid FROM lineitem GROUP BY l_orderkey""")
def html_cell_grid(spark, sf_dir):
    """Order lines as HTML tables, read back into grids. In every fifth order the first cell spans all lines, in every third the last line
    lacks its last cell; the oracle says what grids these are."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("ls"))
    n, key = F.size("ls"), F.col("l_orderkey")

    def line(x, i):
        cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
        whole = F.when(i == 0, F.concat(F.lit("<td rowspan="), n.cast("string"), F.lit(">all</td>"))).otherwise("")
        first = F.when(key % 5 == 0, whole).otherwise(cell(x["l_linenumber"].cast("string")))
        last = F.when((key % 3 == 1) & (i == n - 1), "").otherwise(cell(x["l_linestatus"]))
        return F.concat(F.lit("<tr>"), first, cell(x["l_returnflag"]), last, F.lit("</tr>"))

    html = rows.select("l_orderkey", F.concat(F.lit("<table><tr><th>line</th><th colspan=2>flags</th></tr>"), F.array_join(F.transform("ls", line), ""), F.lit("</table>")).alias("html"))
    return tables.topology(tables.cells_of(html, "l_orderkey", "html"), "l_orderkey")


@query()
def edit_distance_of_turns(spark, sf_dir):
    """Edits between the whole texts of neighbouring turns, in characters. The oracle's levenshtein counts bytes, so tests compare it with a plain one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("s", F.col("text")).withColumn("p", F.lag("s").over(w))
    d = F.levenshtein("s", "p")
    n = F.greatest(F.length("s"), F.length("p"))
    return c.filter(d.isNotNull() & (n > 0)).select("conv_id", "turn", d.cast("long").alias("distance"), F.round(d / n, 6).alias("share"))


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""")
def turn_order_render(spark, sf_dir):
    return M.in_order(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.concat("role", F.lit(": "), "text"))
