"""Deterministic inputs derived from the driver's tables (FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1: image_id, box_id, x0, y0, x1, y1 (long), score, text."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").withColumn("box_id", F.row_number().over(w).cast("long"))
    long, short = 30 + F.col("l_quantity").cast("long"), 6 + (F.col("l_partkey") % 5) * 4
    tall = F.col("l_linenumber") == 7
    x0, y0 = (F.col("l_partkey") % 16) * 12, (F.col("l_suppkey") % 12) * 10
    return li.select(
        F.col("l_orderkey").alias("image_id"), "box_id", x0.alias("x0"), y0.alias("y0"),
        (x0 + F.when(tall, short).otherwise(long)).alias("x1"), (y0 + F.when(tall, long).otherwise(short)).alias("y1"),
        (F.col("l_discount") * 10).alias("score"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"),
    )


def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2: image_id, k, label, score, xmin, ymin, xmax, ymax, read_order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("k"))
    o = o.withColumn("xmin", (F.col("o_custkey") * 3 + F.col("k") * 40) % 160 - 10).withColumn("ymin", (F.col("o_custkey") * 5 + F.col("k") * 30) % 100 - 10)
    return o.select(
        F.col("o_orderkey").alias("image_id"), "k", ((F.col("o_custkey") + F.col("k")) % 11).alias("label"),
        (((F.col("o_orderkey") * 7 + F.col("k") * 13) % 100) / F.lit(100.0)).alias("score"),
        "xmin", "ymin", (F.col("xmin") + 90).alias("xmax"), (F.col("ymin") + 60).alias("ymax"), ((F.col("o_orderkey") + F.col("k") * 5) % 3).alias("read_order"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5: image_id, s, x, y, r, g, b (long), inside."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("s", F.row_number().over(w).cast("long") - 1)
    return e.select(
        F.col("user_id").alias("image_id"), "s", (F.col("s") % 16).alias("x"), F.expr("s div 16").alias("y"),
        (F.col("event_id") * 37 % 256).alias("r"), (F.col("value").cast("long") % 256).alias("g"), ((F.col("event_id") * 91 + F.col("user_id")) % 256).alias("b"),
        (F.col("event_type") != "error").alias("inside"),
    )


# The boxes that every image of D5 gets (box_id, corners, text): as wide as the page, slanted, upright, without text.
COLOUR_BOXES = (
    (1, ((0, 0), (16, 0), (16, 2), (0, 2)), "the quick brown fox"),
    (2, ((2, 0), (13, 1), (12, 4), (1, 3)), "slanted words"),
    (3, ((3, 0), (6, 0), (6, 7), (3, 7)), "縦書き"),
    (4, ((4, 1), (20, 1), (20, 3), (4, 3)), ""),
    (5, ((5, 2), (16, 2), (16, 4), (5, 4)), "ab"),
)


def colour_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10: image_id, box_id, quad, text, width, height: COLOUR_BOXES on every image of D5, which is 16 wide."""
    rows = [(b, [{"x": x, "y": y} for x, y in q], t) for b, q, t in COLOUR_BOXES]
    kinds = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("box_id"), F.array(*[F.struct(F.lit(p["x"]).cast("long").alias("x"), F.lit(p["y"]).cast("long").alias("y")) for p in q]).alias("quad"), F.lit(t).alias("text")) for b, q, t in rows]))
    sizes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("image_id")).agg(F.expr("(count(*) - 1) div 16 + 1").alias("height"))
    return sizes.select("image_id", "height", kinds.alias("k")).select("image_id", "k.*", F.lit(16).cast("long").alias("width"), "height")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4: vec_id, cells (64 doubles: 8 rows of 8)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double") + 0.5).alias("cells"))


def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6: image_id, spans (start, end, r, g, b by place) of the pixels of every image, three places each."""
    p = pixels(spark, sf_dir)
    dim = lambda c: F.expr(f"{c} div 64 * 64").alias(c)
    kids = F.array_sort(F.collect_list(F.struct("s", (F.col("s") * 3).alias("start"), (F.col("s") * 3 + 3).alias("end"), dim("r"), dim("g"), dim("b"))))
    return p.groupBy("image_id").agg(F.transform(kids, lambda k: F.struct(*[k[c].alias(c) for c in ("start", "end", "r", "g", "b")])).alias("spans"))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9: session_id, ts, event_id, op (create, delete, get), payload."""
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("get")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", op.alias("op"), F.col("event_id").cast("string").alias("payload"))


def session_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11: request_id, ts, body of the events that only read: a JSON body of the session and none to two slanted regions; one in 17
    is broken off, one in 19 names no session."""
    e = table(spark, sf_dir, "events").where("event_type not in ('signup', 'error')")
    x, y = (lambda k: (F.col("event_id") * 3 + k * 40) % 150 - 5), (lambda k: (F.col("event_id") * 5 + k * 30) % 90 - 5)
    corners = ((0, 0), (70, 3), (68, 40), (-1, 38))
    box = lambda k: F.struct(*[(f(k) + dx).alias(f"{c}{n + 1}") for n, (dx_, dy) in enumerate(corners) for c, f, dx in (("x", x, dx_), ("y", y, dy))])
    boxes = F.slice(F.array(box(0), box(1)), 1, (F.col("event_id") % 3).cast("int"))
    body = F.when(F.col("event_id") % 17 == 0, F.lit('{"session_id": ')).when(F.col("event_id") % 19 == 0, F.lit('{"session_id": ""}')).otherwise(F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), boxes.alias("bounding_boxes"))))
    return e.select(F.col("event_id").alias("request_id"), "ts", body.alias("body"))


def box_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12: trees of three levels, image to region (D2) to box (D1): tree_id, node_id, parent_id, ord, x0, y0, x1, y1, text. Boxes of no region are children of
    the image; regions without boxes are left out. Every seventh region has text of its own."""
    from ..operators import boxes as B

    box = ["x0", "y0", "x1", "y1"]
    parents = layout_rows(spark, sf_dir).select("image_id", F.col("k").alias("parent_id"), F.col("xmin").alias("x0"), F.col("ymin").alias("y0"), F.col("xmax").alias("x1"), F.col("ymax").alias("y1"))
    children = boxes(spark, sf_dir)
    given = B.assign_children(children, parents)
    leaves = children.join(given.hint("merge"), ["image_id", "box_id"], "left").where("x1 > x0 and y1 > y0")
    leaf = leaves.select("image_id", F.col("box_id").alias("node_id"), F.coalesce(F.col("parent_id") + 900, F.lit(999)).alias("parent_id"), (F.col("box_id") + 10).alias("ord"), *box, F.when(F.col("box_id") % 6 != 5, F.col("text")).otherwise("").alias("text"))
    used = parents.hint("merge").join(given.select("image_id", "parent_id").distinct(), ["image_id", "parent_id"])
    region = used.select("image_id", (F.col("parent_id") + 900).alias("node_id"), F.lit(999).cast("long").alias("parent_id"), F.col("parent_id").alias("ord"), *box, F.when((F.col("image_id") + F.col("parent_id")) % 7 == 0, F.concat(F.lit("r"), F.col("parent_id").cast("string"))).otherwise("").alias("text"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = leaves.select("image_id").distinct().select("image_id", F.lit(999).cast("long").alias("node_id"), none.alias("parent_id"), zero.alias("ord"), *[zero.alias(c) for c in box], F.lit("").alias("text"))
    return root.unionByName(region).unionByName(leaf).withColumnRenamed("image_id", "tree_id")


def small_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13: class, entry: the first letters of four nations as classes 1 to 4; classes 5 to 7 of D3 are not in it."""
    return table(spark, sf_dir, "nation").where("n_nationkey < 4").select((F.col("n_nationkey") + 1).cast("long").alias("class"), F.lower(F.substring("n_name", 1, 1)).alias("entry"))


def routed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14: request_id, ts, route, content_type, body: an upload of the text of every document, in one of seven forms of which four are
    wrong, the session requests of D11, and a request of another route for every nation."""
    form, text = F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    plain = F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")  # Spark breaks lines
    json = lambda v: F.concat(F.lit('{"image": "'), v, F.lit('"}'))
    part = lambda name: F.concat(F.lit(f'--q7f3zz\r\nContent-Disposition: form-data; name="{name}"; filename="a.png"\r\n\r\n'), text, F.lit("\r\n--q7f3zz--\r\n"))
    body = F.when(form == 0, json(plain)).when(form == 1, json(F.translate(plain, "+/", "-_"))).when(form == 2, F.lit('{"image": ')).when(form == 3, json(F.concat(F.lit("?"), plain))).when(form == 4, text).when(form == 5, part("image")).otherwise(part("other"))
    kind = F.when(form < 4, "application/json").when(form == 4, "text/plain").otherwise("multipart/form-data; boundary=q7f3zz")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    uploads = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"), now.alias("ts"), F.when(form == 1, "session_create").otherwise("ocr").alias("route"), kind.alias("content_type"), F.encode(body, "UTF-8").alias("body"))
    asked = session_requests(spark, sf_dir).select(F.concat(F.lit("s"), F.col("request_id").cast("string")).alias("request_id"), "ts", F.lit("session_ocr").alias("route"), F.lit("application/json").alias("content_type"), F.encode("body", "UTF-8").alias("body"))
    n = F.col("n_nationkey") % 3
    others = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("request_id"), now.alias("ts"), F.when(n == 0, "health").when(n == 1, "session_delete").otherwise("elsewhere").alias("route"), F.lit("").alias("content_type"), F.lit(b"").alias("body"))
    return uploads.unionByName(asked).unionByName(others)
