"""Collections of the engine, derived from the driver's tables, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def global_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images: id, embedding, class_id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("class_id"))


def first_query(spark: SparkSession, sf_dir: str, n: int = 1) -> DataFrame:
    """The n images with the smallest ids as queries."""
    return global_docs(spark, sf_dir).orderBy("id").limit(n).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def global_docs_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and slightly changed copies of every fifth, without groups yet."""
    from pixelgrove.functions.vectors import unit

    docs = global_docs(spark, sf_dir).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    copies = docs.where("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), unit(F.transform("embedding", lambda x, i: x * (1 + 0.001 * i))).alias("embedding"))
    return docs.unionByName(copies)


def with_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in groups by label: primary is the smallest id, score falls with the id; every seventh is in none."""
    grouped = (F.col("id") % 7) != 0
    first = F.min(F.when(grouped, F.col("id"))).over(Window.partitionBy("class_id"))
    rows = global_docs(spark, sf_dir).withColumn("__f", first)
    return rows.select(
        "id", F.when(grouped, F.concat(F.lit("dup_"), F.col("class_id").cast("string"))).alias("duplicate_group_id"),
        F.when(grouped, F.col("id") == F.col("__f")).alias("is_duplicate_primary"),
        F.when(grouped, F.when(F.col("id") == F.col("__f"), 1.0).otherwise((F.col("id") * 37 % 1000) / 1000.0)).alias("duplicate_score"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """face_id, embedding, person_id, is_reference, confidence."""
    rows = table(spark, sf_dir, "embeddings")
    first = F.min("vec_id").over(Window.partitionBy("label"))
    return rows.select(F.col("vec_id").alias("face_id"), "embedding", F.col("label").alias("person_id"), (F.col("vec_id") == first).alias("is_reference"), ((F.col("vec_id") % 100) / 100.0).alias("confidence"))


def centroids0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, centroid): the embedding with the smallest id of each label."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy(F.col("label").cast("long").alias("cluster_id")).agg(F.min_by("embedding", "vec_id").alias("centroid"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in images made from line items: image_id, det_id, x1..y2, score, class_id."""
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = rows.withColumns({"det_id": F.row_number().over(order).cast("long"), "x1": (F.col("l_partkey") % 60) / 100.0, "y1": (F.col("l_suppkey") % 60) / 100.0})
    far = lambda c: F.least(F.lit(1.0), F.col(c) + 0.1 + F.col("l_quantity") / 100.0)
    return rows.select(F.col("l_orderkey").alias("image_id"), "det_id", "x1", "y1", far("x1").alias("x2"), far("y1").alias("y2"), (((F.col("l_partkey") * 31 + F.col("l_linenumber") * 17) % 1000) / 1000.0).alias("score"), F.col("l_linenumber").alias("class_id"))


def detections_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = {c: F.least(F.lit(1.0), F.col(c) + 0.01) for c in ("x1", "y1", "x2", "y2")}
    return detections(spark, sf_dir).where("det_id % 7 <> 0").withColumns(moved)


def image_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), (320 + F.col("o_custkey") % 1600).alias("width"), (240 + F.col("o_orderkey") % 1200).alias("height"))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that are not blank: image_id, pos, ocr_id, text, det_score, rec_score."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("trim(text) <> ''")
    return rows.select("image_id", F.col("pos").cast("long").alias("pos"), (F.col("image_id") * 100_000 + F.col("pos")).alias("ocr_id"), "text", (((F.col("image_id") * 7 + F.col("pos")) % 100) / 100.0).alias("det_score"), (((F.col("image_id") * 13 + F.col("pos")) % 100) / 100.0).alias("rec_score"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), F.col("value").alias("latency_ms"), "event_id", "ts", "user_id")


#: The same views in DuckDB SQL, by name; each may use those before it.
SQL = {
    "gdocs": "SELECT vec_id AS id, embedding::DOUBLE[] AS embedding, label AS class_id FROM embeddings",
    "gunit": "SELECT id, class_id, list_transform(embedding, lambda x: x / CASE WHEN list_inner_product(embedding, embedding) = 0 THEN 1 ELSE sqrt(list_inner_product(embedding, embedding)) END) AS u FROM gdocs",
    "dupdocs": """SELECT id, u FROM gunit UNION ALL
        SELECT id + 1000000, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) FROM
        (SELECT id, list_transform(embedding, lambda x, i: x * (1 + 0.001::DOUBLE * (i - 1))) AS e FROM gdocs WHERE id % 5 = 0)""",
    "grouped": """SELECT id, CASE WHEN g THEN 'dup_' || class_id END AS gid, CASE WHEN g THEN id = f END AS prim,
        CASE WHEN g THEN CASE WHEN id = f THEN 1.0 ELSE (id * 37 % 1000) / 1000.0 END END::DOUBLE AS score FROM
        (SELECT id, class_id, id % 7 <> 0 AS g, min(CASE WHEN id % 7 <> 0 THEN id END) OVER (PARTITION BY class_id) AS f FROM gdocs)""",
    "fc": "SELECT vec_id AS face_id, embedding::DOUBLE[] AS embedding, label AS person_id, vec_id = min(vec_id) OVER (PARTITION BY label) AS is_reference, (vec_id % 100) / 100.0::DOUBLE AS confidence FROM embeddings",
    "cent": "SELECT class_id AS cluster_id, arg_min(u, id) AS c FROM gunit GROUP BY class_id",
    "asg": """SELECT id, cluster_id, ip FROM (SELECT id, cluster_id, ip, row_number() OVER (PARTITION BY id ORDER BY ip DESC, cluster_id) AS r FROM
        (SELECT g.id, c.cluster_id, list_inner_product(g.u, c.c) AS ip FROM gunit g CROSS JOIN cent c)) WHERE r = 1""",
    "det": """SELECT image_id, det_id, x1, y1, least(1.0::DOUBLE, x1 + 0.1::DOUBLE + q / 100.0::DOUBLE) AS x2, least(1.0::DOUBLE, y1 + 0.1::DOUBLE + q / 100.0::DOUBLE) AS y2, score, class_id FROM
        (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS det_id,
        (l_partkey % 60)::DOUBLE / 100 AS x1, (l_suppkey % 60)::DOUBLE / 100 AS y1, l_quantity::DOUBLE AS q, ((l_partkey * 31 + l_linenumber * 17) % 1000)::DOUBLE / 1000 AS score, l_linenumber AS class_id FROM lineitem)""",
    "jit": "SELECT image_id, det_id, least(1.0::DOUBLE, x1 + 0.01::DOUBLE) AS x1, least(1.0::DOUBLE, y1 + 0.01::DOUBLE) AS y1, least(1.0::DOUBLE, x2 + 0.01::DOUBLE) AS x2, least(1.0::DOUBLE, y2 + 0.01::DOUBLE) AS y2, score, class_id FROM det WHERE det_id % 7 <> 0",
    "dims": "SELECT o_orderkey AS image_id, 320 + o_custkey % 1600 AS width, 240 + o_orderkey % 1200 AS height FROM orders",
    "lines": """SELECT image_id, pos, image_id * 100000 + pos AS ocr_id, text, ((image_id * 7 + pos) % 100)::DOUBLE / 100 AS det_score, ((image_id * 13 + pos) % 100)::DOUBLE / 100 AS rec_score FROM
        (SELECT doc_id AS image_id, unnest(parts) AS text, unnest(range(len(parts))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE trim(text, ' ') <> ''""",
    "lat": "SELECT event_type AS track, value AS latency_ms, event_id, ts, user_id FROM events",
}
NEEDS = {"gunit": ["gdocs"], "dupdocs": ["gdocs", "gunit"], "grouped": ["gdocs"], "cent": ["gdocs", "gunit"], "asg": ["gdocs", "gunit", "cent"], "jit": ["det"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` after a WITH clause of the named views and those they need."""
    wanted = {n for name in names.split() for n in [name, *NEEDS.get(name, [])]}
    views = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in SQL if n in wanted)
    more = body.lstrip()
    joined = ", " + more[len("WITH ") :] if more.startswith("WITH ") else "\n" + more
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{joined}"
