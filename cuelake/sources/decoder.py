"""JSON and text files of decoders, reviewers and media probes as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import text as T

# Limits of a project's context and of a manifest line, and the packet hash's form.
CONTEXT_BYTES, CONTEXT_CHARS, LINE_BYTES = 65_536, 32_000, 16_384
HASH = r"^SHA256:[0-9A-Fa-f]{64}$"
NUMBER = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("content"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _is(v: Column, path: str, kind: str) -> Column:
    """Is there a value of that kind of type (a pattern)? JSON null is none."""
    return F.coalesce(F.schema_of_variant(_get(v, path, "variant")).rlike(kind), F.lit(False))


def _items(v: Column, path: str, **fields: str) -> tuple[Column, Column]:
    """(items, sound) of an array of objects: are all fields of all items there, and of their kinds?"""
    items = _get(v, path, "array<variant>")

    def typed(x: Column) -> Column:
        ok = F.lit(True)
        for name, kind in fields.items():
            ok &= _is(x, name, kind)
        return ok

    return items, F.coalesce(F.forall(items, typed), F.lit(False))


def _judged(files: DataFrame, sound: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(media_id, doc) of files that are one JSON document and sound, and (media_id, reason) of the others: json or fields."""
    rows = files.select("media_id", T.one_document(F.col("content")).alias("doc"))
    rows = rows.withColumn("reason", F.when(F.col("doc").isNull(), "json").when(~F.coalesce(sound(F.col("doc")), F.lit(False)), "fields"))
    return rows.where("reason IS NULL").select("media_id", "doc"), rows.where("reason IS NOT NULL").select("media_id", "reason")


def asr_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(segments, words, headers, rejects) of decoder JSON (media_id, content): seconds become cs, what has no text or no length goes; idx is the place in the file.

    headers: (media_id, language, duration_cs, duration_after_vad_cs). A file that is no JSON document, or lacks a field or has one of another type, is rejected whole; fields beyond these are left alone.
    """
    timed = {"text": "^STRING$", "start": NUMBER, "end": NUMBER}

    def sound(doc: Column) -> Column:
        head = _is(doc, "language", "^STRING$") & _is(doc, "duration", NUMBER) & _is(doc, "duration_after_vad", NUMBER)
        return head & _items(doc, "segments", **timed)[1] & _items(doc, "words", **timed)[1]

    rows, rejects = _judged(files, sound)
    cs = lambda v, path: T.seconds_to_cs(_get(v, path, "double"))

    def table(name: str, at: int) -> DataFrame:
        x = F.col("x")
        each = rows.select("media_id", F.posexplode(_get(F.col("doc"), name, "array<variant>")).alias("i", "x"))
        each = each.select("media_id", (F.col("i") + at).cast("long").alias("idx"), cs(x, "start").alias("start_cs"), cs(x, "end").alias("end_cs"), _get(x, "text", "string").alias("text"))
        return (each.withColumn("text", T.trim_all(F.col("text"))) if at else each).where("end_cs > start_cs AND text <> ''")

    doc = F.col("doc")
    headers = rows.select("media_id", _get(doc, "language", "string").alias("language"), cs(doc, "duration").alias("duration_cs"), cs(doc, "duration_after_vad").alias("duration_after_vad_cs"))
    return table("segments", 1), table("words", 0), headers, rejects


def review_reports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, rejects) of report files: (media_id, language, stage, changed_cues, issues), language null for the report of a single stage, a row for each target of a translation."""
    issue = {"cue_id": "^BIGINT$", "kind": "^STRING$", "message": "^STRING$"}
    whole = lambda v: _is(v, "stage", "^STRING$") & _is(v, "changed_cues", "^BIGINT$") & _items(v, "issues", **issue)[1]
    targets = lambda v: _get(v, "targets", "array<variant>")

    def sound(doc: Column) -> Column:
        each = F.forall(targets(doc), lambda t: _is(t, "language", "^STRING$") & whole(_get(t, "review", "variant")))
        return _is(doc, "schema_version", "^BIGINT$") & F.coalesce(F.when(_is(doc, "targets", "^ARRAY"), each).otherwise(whole(doc)), F.lit(False))

    rows, rejects = _judged(files, sound)
    doc = F.col("doc")
    one = F.array(F.struct(F.lit(None).cast("string").alias("language"), doc.alias("review")))
    many = F.transform(targets(doc), lambda t: F.struct(_get(t, "language", "string").alias("language"), _get(t, "review", "variant").alias("review")))
    each = rows.select("media_id", F.explode(F.when(_is(doc, "targets", "^ARRAY"), many).otherwise(one)).alias("t"))
    part = lambda path, kind: _get(F.col("t.review"), path, kind).alias(path)
    return each.select("media_id", "t.language", part("stage", "string"), part("changed_cues", "bigint"), part("issues", "array<struct<cue_id:bigint,kind:string,message:string>>")), rejects


def render_reports(reports: DataFrame, version: int = 1) -> DataFrame:
    """(media_id, content) of reports as review_reports() gives them: the JSON of a single stage where language is null, else of all targets in order of language."""
    review = F.struct("stage", "changed_cues", F.coalesce("issues", F.array().cast(reports.schema["issues"].dataType)).alias("issues"))
    single = reports.where("language IS NULL").select("media_id", F.to_json(F.struct(F.lit(version).alias("schema_version"), "stage", "changed_cues", review["issues"].alias("issues"))).alias("content"))
    several = reports.where("language IS NOT NULL").groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("language", review.alias("review")))).alias("targets"))
    return single.unionByName(several.select("media_id", F.to_json(F.struct(F.lit(version).alias("schema_version"), "targets")).alias("content")))


def write_reports(reports: DataFrame, path: str) -> None:
    """A folder per media item with its report as one text file; an existing path is left alone and is an error."""
    render_reports(reports).write.partitionBy("media_id").text(path)


def media_probe(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(probes, rejects) of probe JSON: (media_id, width, height, duration_s, fps, frame_count, video_stream_count, audio), and (media_id, reason) of files that are no
    probe (json, fields) or hold no usable video (video, size, duration)."""
    text = "^STRING$"
    optional = lambda s, name, kind: ~_is(s, name, "^(?!VOID)") | _is(s, name, kind)

    def sound(doc: Column) -> Column:
        def stream(s: Column) -> Column:
            ok = _is(s, "codec_type", text)
            for name in ("codec_name", "nb_frames", "avg_frame_rate", "sample_rate"):
                ok &= optional(s, name, text)
            for name in ("width", "height", "channels"):
                ok &= optional(s, name, "^BIGINT$")
            return ok

        return F.coalesce(F.forall(_get(doc, "streams", "array<variant>"), stream), F.lit(False)) & _is(doc, "format", "^OBJECT") & optional(doc, "format.duration", text)

    rows, rejects = _judged(files, sound)
    streams = F.transform(_get(F.col("doc"), "streams", "array<variant>"), lambda s: F.struct(*[_get(s, n, k).alias(n) for n, k in {"codec_type": "string", "codec_name": "string", "width": "int", "height": "int", "nb_frames": "string", "avg_frame_rate": "string", "sample_rate": "string", "channels": "int"}.items()]))
    rows = rows.select("media_id", streams.alias("streams"), _get(F.col("doc"), "format.duration", "string").try_cast("double").alias("duration_s"))
    kind = lambda name: F.filter("streams", lambda s: s["codec_type"] == name)
    audio = F.transform(kind("audio"), lambda s: F.struct(F.coalesce(s["codec_name"], F.lit("unknown")).alias("codec"), s["sample_rate"].try_cast("int").alias("sample_rate"), s["channels"].alias("channels")))
    rows = rows.select("media_id", F.get(kind("video"), 0).alias("v"), "duration_s", F.size(kind("video")).alias("video_stream_count"), audio.alias("audio"))
    good = lambda c: F.coalesce(c, F.lit(False))
    reason = F.when(F.col("v").isNull(), "video").when(~good((F.col("v.width") > 0) & (F.col("v.height") > 0)), "size").when(~good((F.col("duration_s") > 0) & (F.col("duration_s") < float("inf"))), "duration")
    rows = rows.withColumn("reason", reason)
    probes = rows.where("reason IS NULL").select("media_id", "v.width", "v.height", "duration_s", T.parse_rate(F.col("v.avg_frame_rate")).alias("fps"), F.col("v.nb_frames").try_cast("long").alias("frame_count"), "video_stream_count", "audio")
    return probes, rejects.unionByName(rows.where("reason IS NOT NULL").select("media_id", "reason"))


def packet_manifest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets, rejects) of manifests (media_id, content): a line per packet, fields name=value between bars. One bad line rejects its file."""
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: T.trim_all(x) != "")
    rows = files.select("media_id", F.posexplode(lines).alias("packet_no", "line"))

    def field(name: str) -> Column:
        """The value of the last field of that name."""
        mine = F.filter(F.split("line", r"\|"), lambda x: F.startswith(x, F.lit(f"{name}=")))
        return F.get(F.transform(mine, lambda x: F.substring(x, len(name) + 2, F.length(x))), F.size(mine) - 1)

    def time(name: str) -> tuple[Column, Column]:
        value = field(name)
        known = value.isNotNull() & (value != "N/A")
        number = F.when(known, value.try_cast("double"))
        return number, known & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")))

    times = {n: time(f"{n}_time") for n in ("pts", "dts", "duration")}
    size, digest = F.when(field("size").rlike(r"^\d+$"), field("size").try_cast("long")), field("data_hash")
    bad = ~F.coalesce(digest.rlike(HASH), F.lit(False)) | size.isNull() | (F.octet_length("line") > LINE_BYTES)
    for _, wrong in times.values():
        bad |= F.coalesce(wrong, F.lit(False))
    rows = rows.select("media_id", "packet_no", digest.alias("hash"), size.alias("size"), *[v.alias(k) for k, (v, _) in times.items()], bad.alias("bad"))
    rejects = rows.where("bad").select("media_id").distinct()
    return rows.drop("bad").join(rejects, "media_id", "left_anti"), rejects


def contexts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contexts, rejects) of context texts (media_id, content): those over either limit are rejected."""
    fits = (F.octet_length("content") <= CONTEXT_BYTES) & (F.length("content") <= CONTEXT_CHARS)
    return files.where(fits), files.where(~fits).select("media_id")
