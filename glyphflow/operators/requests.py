"""Requests as rows: parsed, answered from the session they name, and put together again; no bad row ends a job.

Every request ends as one row with status 200, 400 (not readable, or without a session), 404 (no such session at its time) or
500 (its image cannot be read). Regions of a request are recognised apart, in any order, and appended in the order asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

PAD = 10
FLAT = [f"{c}{k}" for k in (1, 2, 3, 4) for c in "xy"]
BODY = f"session_id string, bounding_boxes array<struct<{','.join(f'{c}:bigint' for c in FLAT)}>>, whole string"
POINTS = "array<struct<x:bigint,y:bigint>>"


def quad(flat: Column) -> Column:
    """The quad of eight flat coordinates x1, y1 to x4, y4 (absent ones are 0)."""
    at = lambda c: F.coalesce(flat[c], F.lit(0).cast("long"))
    return F.array(*[F.struct(at(f"x{k}").alias("x"), at(f"y{k}").alias("y")) for k in (1, 2, 3, 4)])


def parsed(requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, ts, body) with session_id, quads (null: none asked) and error: a body that is no JSON or names
    no session is an error of 400."""
    body = F.from_json("body", BODY, {"columnNameOfCorruptRecord": "whole"})
    r = requests.select("request_id", "ts", body.alias("b"))
    bad = F.col("b").isNull() | F.col("b.whole").isNotNull() | (F.coalesce("b.session_id", F.lit("")) == "")
    quads = F.when(F.size("b.bounding_boxes") > 0, F.transform("b.bounding_boxes", quad))
    return r.select("request_id", "ts", F.when(~bad, F.col("b.session_id")).alias("session_id"), F.when(~bad, quads).alias("quads"), F.when(bad, F.lit("missing session_id")).alias("error"))


def as_of(requests: DataFrame, log: DataFrame, bucket: int = 3600) -> DataFrame:
    """``requests`` (session_id, ts, further columns) with alive and value: the state of its session at its time, after all that
    the log (session_id, ts, event_id, op, payload) holds up to then.

    No join of requests to operations: both are rows of one frame, and a running last value answers. A session is parted into
    ``bucket`` seconds, so that a hot one is no single task: the last change of each bucket is carried over those that follow
    (a row a bucket), and rows look only inside their own.
    """
    names = [c for c in requests.columns if c not in ("session_id", "ts")]
    asked = requests.where("session_id is not null").select(F.col("session_id").cast("string").alias("session_id"), "ts", F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("late"), F.struct(*names).alias("asked"), F.lit(None).cast("struct<alive:boolean,payload:string>").alias("change"))
    change = F.struct((F.col("op") == "create").alias("alive"), F.when(F.col("op") == "create", F.col("payload").cast("string")).alias("payload"))
    told = log.where("op <> 'get'").select(F.col("session_id").cast("string").alias("session_id"), "ts", "event_id", F.lit(0).alias("late"), F.lit(None).cast(asked.schema["asked"].dataType).alias("asked"), change.alias("change"))
    both = asked.unionByName(told).withColumn("bucket", F.floor(F.unix_timestamp("ts") / bucket))
    ends = both.where("change is not null").groupBy("session_id", "bucket").agg(F.max_by("change", F.struct("ts", "event_id")).alias("end"))
    buckets = both.select("session_id", "bucket").distinct().join(ends, ["session_id", "bucket"], "left")
    before = Window.partitionBy("session_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("session_id", "bucket", F.last("end", ignorenulls=True).over(before).alias("carried"))
    upto = Window.partitionBy("session_id", "bucket").orderBy("ts", "late", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = both.withColumn("own", F.last("change", ignorenulls=True).over(upto)).where("late = 1").join(buckets, ["session_id", "bucket"])
    now = F.coalesce("own", "carried")
    return state.select("session_id", "ts", "asked.*", F.coalesce(now["alive"], F.lit(False)).alias("alive"), now["payload"].alias("value"))


def asked_regions(requests: DataFrame) -> DataFrame:
    """``requests`` (with quads) once for each region, with seq and quad (both null: the whole image)."""
    names = [c for c in requests.columns if c != "quads"]
    return requests.select(*names, F.posexplode_outer("quads").alias("seq", "quad"))


def placed(box: Column, region: Column, pad: int = PAD) -> Column:
    """Corners found in the padded crop of ``region`` (its quad; null: they are in place), back in the image and clamped to its bounds."""
    b = g.bounds(region)
    back = lambda p, c: g.clamp(p[c] - pad + b[c + "0"], b[c + "0"], b[c + "1"]).alias(c)
    return F.when(region.isNull(), box).otherwise(F.transform(box, lambda p: F.struct(back(p, "x"), back(p, "y"))))


def answered(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """request_id, status, detail, results (box, text, score in the order of regions and lines), full_text of every request.
    ``requests``: request_id, error, session_id, alive (null where not asked); ``lines``: request_id, seq, line, text, score, box."""
    kid = F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "line", "box", "text", "score")
    got = lines.groupBy("request_id").agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    status = F.when(F.col("error").isNotNull(), 400).when(~F.col("alive"), 404).otherwise(200).cast("long")
    detail = F.coalesce("error", F.when(~F.col("alive"), F.concat(F.lit("session "), F.col("session_id").cast("string"), F.lit(" not found"))))
    results = F.coalesce(F.transform("kids", lambda k: F.struct(k["box"].alias("box"), k["text"].alias("text"), k["score"].alias("score"))), F.array().cast(f"array<struct<box:{POINTS},text:string,score:double>>"))
    rows = requests.join(got, "request_id", "left").select("request_id", status.alias("status"), detail.alias("detail"), results.alias("results"))
    ok = F.col("status") == 200
    return rows.select("request_id", "status", "detail", F.when(ok, F.col("results")).alias("results"), F.when(ok, F.array_join(F.transform("results", lambda k: k["text"]), "\n")).alias("full_text"))


def session_requests(requests: DataFrame, log: DataFrame) -> DataFrame:
    """request_id, session_id, quads, error, alive, value of every request (request_id, ts, body) against a session log."""
    p = parsed(requests)
    at = as_of(p.where("error is null").select("request_id", "session_id", "ts"), log).select("request_id", "alive", "value")
    return p.drop("ts").join(at, "request_id", "left")


ROUTES = ("health", "ocr", "detect", "session_create", "session_delete", "session_detect", "session_ocr")


def session_ids(given: Column) -> Column:
    """The session id of a request: the one given, else a new random one."""
    return F.coalesce(F.nullif(given, F.lit("")), F.uuid())


def routed(requests: DataFrame, log: DataFrame, ready: bool = True) -> DataFrame:
    """request_id, status, detail, reason (of a 400), n_bytes (of its image) of every request (request_id, ts, route, content_type, body as
    bytes): what a server would answer before any model runs. Unknown routes are 404; no row ends the job."""
    from ..sources import images

    names = ["request_id", "status", "detail", "reason", "n_bytes"]
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("long")
    r, known = requests.withColumn("route", F.coalesce("route", F.lit(""))), F.col("route")
    uploads = images.requests(r.where(known.isin("ocr", "detect", "session_create")))
    bad = F.col("error").isNotNull()
    uploads = uploads.select("request_id", F.when(bad, 400).otherwise(200).cast("long").alias("status"), F.when(bad, "invalid or missing image").alias("detail"), "reason", F.octet_length("content").cast("long").alias("n_bytes"))
    asked = session_requests(r.where(known.isin("session_detect", "session_ocr")).select("request_id", "ts", F.decode("body", "UTF-8").alias("body")), log)
    lost = F.concat(F.lit("session "), F.col("session_id"), F.lit(" not found"))
    asked = asked.select("request_id", F.when(F.col("error").isNotNull(), 400).when(F.col("alive"), 200).otherwise(404).cast("long").alias("status"), F.coalesce("error", F.when(~F.col("alive"), lost)).alias("detail"), F.col("error").alias("reason"), nothing.alias("n_bytes"))
    down = (known == "health") & F.lit(not ready)
    rest = r.where(~known.isin("ocr", "detect", "session_create", "session_detect", "session_ocr"))
    code = F.when(down, 503).when(known.isin("health", "session_delete"), 200).otherwise(404).cast("long")
    rest = rest.select("request_id", code.alias("status"), F.when(down, "ocr engine not ready").when(~known.isin(*ROUTES), "not found").alias("detail"), none.alias("reason"), nothing.alias("n_bytes"))
    return uploads.select(*names).unionByName(asked.select(*names)).unionByName(rest.select(*names))


def recognised(engine, regions: DataFrame) -> DataFrame:
    """request_id, seq, line, text, score, box (in the image) of what ``engine`` reads in every region. ``regions``: request_id, seq,
    quad, content (bytes of the image). A region whose image or stages fail has no lines, as one without text."""
    from . import raster
    from ..sources import images

    out = f"request_id long, seq int, line long, text string, score double, found {POINTS}"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for r in b.itertuples(index=False):
                try:
                    image = images.decode(r.content)
                    if r.quad is not None:
                        image = raster.cropped_quad(image, [(p["x"], p["y"]) for p in r.quad], PAD)
                    lines = engine.run(image)
                except Exception:  # noqa: BLE001, S112
                    continue
                seq = None if pd.isna(r.seq) else int(r.seq)
                got += [(r.request_id, seq, k, text, score, [{"x": x, "y": y} for x, y in box.quad]) for k, (box, text, score, _) in enumerate(lines)]
            yield pd.DataFrame(got, columns=["request_id", "seq", "line", "text", "score", "found"]).astype({"seq": "Int32"})

    keyed = regions.select("request_id", F.col("seq").cast("int").alias("seq"), "quad", "content")
    read = keyed.mapInPandas(rows, out)
    places = regions.select("request_id", F.col("seq").cast("int").alias("seq"), "quad")
    same = (read["request_id"] == places["request_id"]) & read["seq"].eqNullSafe(places["seq"])
    return read.join(places, same).select(read["request_id"], read["seq"], "line", "text", "score", placed(F.col("found"), F.col("quad")).alias("box"))


def session_ocr(engine, requests: DataFrame, log: DataFrame, pictures: DataFrame) -> DataFrame:
    """The answers of ``engine`` to ``requests`` on the images of their sessions. ``pictures``: value, content (what a log's payload names)."""
    r = session_requests(requests, log)
    regions = asked_regions(r.where("alive").select("request_id", "value", "quads")).join(pictures, "value")
    return answered(r, recognised(engine, regions))
