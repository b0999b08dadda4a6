"""Registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.settle import settle
from plumbline.llm import chat, fm_index, graph_search, html_text, language_id, line_dedup, packing, periodic, perplexity, prefix_trie, secrets, shards, simhash

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(plan):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return keep


def lower_sql(text: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


CONTROLS = "</s>[INST] ok [/INST]"


@query(
    "op1_chat_format",
    r"""
    WITH messages AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id,
           count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
           CAST(sum(length(role || text) + 23 + len(regexp_extract_all(role || ' ' || text, '[<\[]\\*(?:\||/?s>|</?SYS>>|/?INST\])'))) AS BIGINT) AS formatted_chars,
           0::BIGINT AS attachment_tokens
    FROM messages GROUP BY conv_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROLS).alias("text")
    )
    done = chat.format_conversations(given.union(own).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    turns = F.array_join(F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat.masked(F.col("formatted"), F.col("loss_mask")), "")
    return done.select(
        "conv_id",
        (F.size(F.split("formatted", r"<\|turn\|>", -1)) - 1).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "attachment_tokens",
    )


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.RULES[:3]]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "row.doc_id",
        *(count(kind) for kind in base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op3_html_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    sample = language_id.sample_texts(docs.where(~held_out).select("lang", "text"))
    told = language_id.predict(docs.select("doc_id", "text"), sample)
    return told.select("row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return judged.select("row.doc_id", *perplexity.RULES, "base_failed", "kept", "perplexity")


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def words_sql(table_name: str, number: str) -> str:
    return (
        f"SELECT {number}, regexp_extract_all({lower_sql("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table_name}"
    )


@query(
    "op8_benchmark_decontamination",
    f"""
    WITH doc_words AS ({words_sql("documents", "doc_id")}),
    item_words AS ({words_sql("benchmark", "item_id")}),
    item_windows AS (
        SELECT DISTINCT item_id, n, w[i : i + n - 1] AS win
        FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
    ),
    doc_windows AS (
        SELECT doc_id, n, i, w[i : i + n - 1] AS win
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
    ),
    found AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, win)),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query(
    "op9_line_dedup",
    f"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
    ),
    keyed AS (SELECT *, {lower_sql("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
    held AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM (SELECT doc_id, line, pos, coalesce(doc_id <> first_doc, false) AS gone FROM keyed LEFT JOIN held USING (key))
    GROUP BY doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.deduplicated(docs)
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


WHITE = "[\\x20\\x09-\\x0D]+"


def repeated_from(words, n, a, p):
    """Words from number ``a`` on replaced by repetitions of the first ``p`` of them, ``n`` words in all."""
    unit = F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    return F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - a))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", WHITE), "")
    n = F.size(words)
    g = F.floor(h / 10)
    a = F.pmod(g, F.nullif(n, F.lit(0))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    made = F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(repeated_from(words, n, a, p), " ")).otherwise(F.col("text"))
    found = periodic.find_runs(docs.select("doc_id", made.alias("text")))
    # The greatest length / period without division: cross products of whole numbers.
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | (
        (x["length"] * y["period"] == y["length"] * x["period"]) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"]))
    )
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda acc, r: F.when(acc.isNull() | better(r, acc), r).otherwise(acc))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    shown = found.select("row.doc_id", "runs", "collapsed", best.alias("best"), listed.alias("listed"))
    return shown.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Conversations of a family, the bound on the turns of its first one that they share, and turns moved under one key.
FAMILY, OPENING, TURNS = 20, 4, 4096


def reopened(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (digested) and ids of conversations that start with up to three turns of the first of their family."""
    turns = settle(prefix_trie.digested(prefix_trie.numbered_turns(conversations)))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(OPENING))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    ids = settle(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", h.alias("h"), family.alias("_base")))
    opening = turns.where((F.col("pos") < OPENING) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("_base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_key", "n_words"))).alias("_opening")
    )
    none = F.array().cast("array<struct<pos:bigint,turn_key:string,n_words:bigint>>")
    opened = settle(ids.join(opening, "_base", "left").select("conv_id", "n", "h", F.slice(F.coalesce("_opening", none), F.lit(1), F.col("h").cast("int")).alias("_first")))
    first = opened.select("conv_id", F.explode("_first").alias("_t")).select("conv_id", "_t.*")
    # In blocks of turns, so that no conversation is one key.
    block = F.floor(F.col("pos") / TURNS).cast("long")
    shifts = opened.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / TURNS).cast("long"))).alias("_block"), "h", F.size("_first").alias("_n"))
    own = turns.withColumn("_block", block).join(shifts, ["conv_id", "_block"]).where(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("_n")).alias("pos"), "turn_key", "n_words")
    return first.unionByName(own), ids.select("conv_id")


@query(
    "op12_prefix_trie",
    r"""
    WITH crc_table AS (
        SELECT list(list_reduce([n] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t
        FROM (SELECT unnest(range(256)) AS n)
    ),
    ids AS (
        SELECT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table
    ),
    turns AS (
        SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
    ),
    opened AS (
        SELECT i.conv_id, 0 AS own, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 20 AND t.pos <= i.h
        UNION ALL
        SELECT i.conv_id, 1, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h
    ),
    rebuilt AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, text,
               string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING) AS prefix
        FROM opened
    ),
    steps AS (
        SELECT conv_id, 0 AS depth, '' AS prefix, CAST(NULL AS VARCHAR) AS parent, 0 AS words FROM ids
        UNION ALL
        SELECT conv_id, depth, prefix, coalesce(lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth), ''), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM rebuilt
    ),
    lasts AS (SELECT conv_id, max(depth) AS depth FROM steps GROUP BY conv_id),
    ends AS (SELECT prefix, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM steps JOIN lasts USING (conv_id, depth) GROUP BY prefix),
    nodes AS (
        SELECT prefix, min(depth) AS depth, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved FROM steps GROUP BY prefix
    ),
    children AS (SELECT parent AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
    subtrees AS (
        SELECT s.prefix, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(u.saved) AS saved_tokens
        FROM nodes u JOIN steps s ON s.conv_id = u.conv_id AND s.depth <= u.depth LEFT JOIN children c ON c.prefix = u.prefix GROUP BY s.prefix
    )
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
           CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM nodes n JOIN subtrees t USING (prefix) LEFT JOIN children c USING (prefix) LEFT JOIN ends e USING (prefix)
    LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.parent
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = reopened(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.build(turns, ids)


@query("op11_graph_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_search.nearest(vectors, F.col("id") % 20 == 0, 20)
