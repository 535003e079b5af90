"""Results of media analysis back into messages; events; jobs and queues; containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import dates as date_functions, media as media_functions, messages as message_functions

RESULT = "description string, is_meme boolean, tags array<string>, transcript string, cleaned_transcript string, text string, page_count int"


def described_by(task: Column, result: Column, old: Column, cut: int = 500) -> Column:
    """The description that a task's result gives a medium: of an image its own, of a sound the cleaned transcript or the plain one, of
    a document its beginning and number of pages; the old one for other tasks."""
    text, pages = result["text"], result["page_count"]
    begun = F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.substring(text, 1, cut), F.when(F.length(text) > cut, "...").otherwise("")))
    counted = F.when(F.coalesce(pages, F.lit(0)) != 0, F.concat(F.lit("Pages: "), pages.cast("string")))
    heard = F.coalesce(F.nullif(result["cleaned_transcript"], F.lit("")), result["transcript"])
    return F.when(task == "analyze_image", result["description"]).when(task == "transcribe_audio", heard).when(task == "analyze_pdf", F.concat_ws(" | ", begun, counted)).otherwise(old)


def enriched(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Messages of completed tasks with the description, meme flag and tags found, and the content with its media mark filled.

    messages: source_id, doc_id, content, media struct(type, description, is_meme, tags); results: source_id, doc_id, task, status,
    result (JSON). Tasks without a result, and results without a message, give nothing."""
    done = results.filter((F.col("status") == "completed") & F.col("result").isNotNull()).select("source_id", "doc_id", "task", F.from_json("result", RESULT).alias("r"))
    rows = messages.join(done, ["source_id", "doc_id"])
    old, r, image = F.col("media"), F.col("r"), F.col("task") == "analyze_image"
    said = described_by(F.col("task"), r, old["description"])
    kind = F.coalesce(F.nullif(old["type"], F.lit("")), F.lit("media"))
    content = F.when(F.coalesce(said, F.lit("")) != "", media_functions.retagged(F.col("content"), kind, said)).otherwise(F.col("content"))
    tags = F.when(image, F.nullif(F.array_join(r["tags"], ", "), F.lit(""))).otherwise(old["tags"])
    return rows.select("source_id", "doc_id", said.alias("description"), F.when(image, r["is_meme"]).otherwise(old["is_meme"]).alias("is_meme"), tags.alias("tags"), content.alias("content"))


def event_candidates(documents: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each kind of event that a document not yet processed may tell of."""
    fresh = documents.join(processed.select(*keys), keys, "left_anti")
    return fresh.withColumn("event_type", F.explode(message_functions.event_types("content")))


def event_rows(documents: DataFrame, processed: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """The events that documents not yet processed tell of: keys, event_type, title, start_time, end_time, payload (JSON of amount, keyword
    and title) and evidence_msg_id. documents: keys, doc_id, content."""
    fresh = documents.join(processed.select(*keys), keys, "left_anti")
    told = fresh.withColumn("e", F.explode(date_functions.events(F.col("content"), message_functions.EVENT_WORDS, today)))
    payload = F.to_json(F.struct("e.amount", "e.keyword", "e.title"))
    return told.select(*keys, "e.event_type", "e.title", "e.start_time", F.col("e.start_time").alias("end_time"), payload.alias("payload"), *([] if "doc_id" in keys else ["doc_id"]), F.col("doc_id").alias("evidence_msg_id"))


def first_events(events: DataFrame, order: list[str]) -> DataFrame:
    """Of events with an equal title (but for case and blanks) and start, null starts equal too, the first by the order."""
    w = Window.partitionBy(F.lower(F.trim("title")), "start_time").orderBy(*order)
    return events.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def stored_events(base: DataFrame, events: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """The base and the events it lacks by the keys, null keys equal, with defaults for what an event leaves open."""
    filled = events.withColumn("event_type", F.coalesce("event_type", F.lit("other"))).withColumn("start_time", F.coalesce("start_time", now)).withColumn("end_time", F.coalesce("end_time", now)).withColumn("title", F.coalesce("title", F.lit("Untitled event")))
    known = base.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return base.unionByName(filled.dropDuplicates(keys).join(known, same, "left_anti").select(*base.columns))


def job_states(tasks: DataFrame, sealed: DataFrame) -> DataFrame:
    """Counts by status of each job (job, status), and whether it is done: sealed, with tasks, none of them pending or processing."""
    kinds = ("pending", "processing", "completed", "failed")
    counts = tasks.groupBy("job").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    every = counts.join(sealed.select("job", F.lit(True).alias("sealed")).distinct(), "job", "full_outer").fillna(0, ["total", *kinds]).withColumn("sealed", F.coalesce("sealed", F.lit(False)))
    return every.withColumn("done", F.col("sealed") & (F.col("total") > 0) & (F.col("pending") == 0) & (F.col("processing") == 0))


def containers(stats: DataFrame, names: DataFrame, processes: DataFrame) -> DataFrame:
    """Containers (name, cpu, memory) with the graphics memory and number of their processes; the largest first.

    names: container, name; processes: container (null or unknown ones count nowhere), used."""
    used = processes.join(names, "container").groupBy("name").agg(F.sum("used").alias("vram"), F.count("*").alias("processes"))
    rows = stats.join(used, "name", "left").withColumn("vram", F.coalesce("vram", F.lit(0))).withColumn("processes", F.coalesce("processes", F.lit(0)))
    return rows.orderBy(F.desc_nulls_last("vram"), F.desc_nulls_last("memory"), F.desc_nulls_last("cpu"))
