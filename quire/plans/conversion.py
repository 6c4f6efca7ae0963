"""Conversion of page images to documents: detection, verification, transcription, stitching, repair.

Every model call is a row of a requests table, its reply a row of a remembered one (``models.Memory``);
all between is expressions and joins on (doc_id, page_num).  Images stay in tables of their own (one for
each size a model is shown) with their keys; what is known already is found by key, and only rows that
have to be asked about get their pictures, last, just before the call.

Transcription is sequential within a document, as a page sees the end and the outline of those before
it: it goes in waves, page k of all documents that have one at once.  A wave is one job in which a page is transcribed,
reviewed and, where its score is low, tried once more; its replies are remembered and its result is
stored before the next wave begins, so a run that breaks off goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import boxes, replies, text
from quire.operators import figures, stitching, tables
from quire.plans import models, prompts
from quire.sources import images, sink, storage
from quire.sources.storage import stored

KEY = ["doc_id", "page_num"]
# Fixed value: percent done while pages are stitched
STITCHING = 92
NO_FIGURES = f"array<{boxes.FIGURE}>"


def shown(sized: DataFrame) -> DataFrame:
    """``sized`` (with images), stored with the key of the images."""
    return stored(sized.withColumn("images_key", models.images_key(F.col("images"))))


#: hears of a step and the percent done
Progress = Callable[[str, int], None]


class Caller:
    """Asks a model about rows: its client's factory, where replies are remembered, and what it may be asked at most.

    Without a folder to remember replies in, those of this run are kept in one of its own, so that
    nothing that fails later makes it ask again.
    """

    def __init__(self, factory: Callable[[], models.ModelClient], memory: str | None = None, limits: models.Limits = models.Limits(), progress: Progress | None = None):  # noqa: B008
        self.factory, self.memory, self.limits, self.progress = factory, memory, limits, progress

    def folder(self, rows: DataFrame, name: str) -> str:
        self.memory = self.memory or storage.shared_folder(rows.sparkSession)
        return f"{self.memory.rstrip('/')}/{name}"

    def __call__(self, rows: DataFrame, pictures: DataFrame | None, stage: str, prompt: Column, temperature: float, max_tokens: int, system: str = "") -> DataFrame:
        """Key columns, reply (null where the call failed) and error. ``pictures``: key columns, images and their key."""
        asked = rows.select(*KEY, F.lit(stage).alias("stage"), "model", F.lit(system).alias("system"), prompt.alias("prompt"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))
        told = models.remembered(with_keys(asked, pictures), self.factory, self.folder(rows, stage), self.limits, lambda few: with_images(few, pictures))
        return stored(told.select(*KEY, "reply", "error"))


def with_keys(rows: DataFrame, pictures: DataFrame | None) -> DataFrame:
    """``rows`` with the keys of their pictures, which are not read."""
    known = rows.withColumn("images_key", F.lit("")) if pictures is None else rows.join(pictures.select(*KEY, "images_key"), KEY, "left")
    return known.withColumn("images_key", F.coalesce("images_key", F.lit("")))


def beside(rows: DataFrame, pictures: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with their ``pictures``, which are shuffled and never broadcast.

    Spark goes by the size of files, and plain pictures are many times as large as theirs: all of them
    would go through the driver.
    """
    return rows.join(pictures.hint("merge"), KEY, how)


def with_images(rows: DataFrame, pictures: DataFrame | None) -> DataFrame:
    nothing = F.array().cast(images.IMAGES)
    return rows.withColumn("images", nothing) if pictures is None else beside(rows, pictures.select(*KEY, "images"), "left").withColumn("images", F.coalesce("images", nothing))


def with_context(pages: DataFrame, whole: DataFrame, ask: Caller) -> DataFrame:
    """``pages`` with ``doc_context``, asked for on the first page; empty where the call failed."""
    told = ask(pages.filter("page_num = 0"), whole, "context", F.lit(prompts.CONTEXT), 0.0, 200)
    return pages.join(told.select("doc_id", F.coalesce(text.strip(F.col("reply")), F.lit("")).alias("doc_context")), "doc_id", "left").withColumn("doc_context", F.coalesce("doc_context", F.lit("")))


def detected(pages: DataFrame, searched: DataFrame, ask: Caller) -> DataFrame:
    """doc_id, page_num, figures: two detectors, the first tried twice, and a looser prompt if both find nothing.

    Boxes in pixels are those of the image that was ``searched``.
    """
    none = F.array().cast(NO_FIGURES)
    size = searched.select(*KEY, F.col("sent_width").alias("width"), F.col("sent_height").alias("height"))
    read = lambda told, parse: told.join(size, KEY).select(*KEY, F.coalesce(parse(F.col("reply"), F.col("width"), F.col("height")), none).alias("figures"))
    json_ = lambda rows, t: read(ask(rows, searched, "detect", prompts.detect(F.col("doc_context")), t, 2048, prompts.DETECT_SYSTEM), replies.detected)
    some = lambda df: df.filter(F.size("figures") > 0)
    first = some(json_(pages, 0.15))
    second = some(json_(pages.join(first, KEY, "left_anti"), 0.30))
    found = first.unionByName(second)
    own = pages.filter(text.provider_of(F.col("model")) != "gemini")
    boxed = some(read(ask(own, searched, "boxes", F.lit("qwenvl markdown"), 0.1, 4096), replies.commented))
    left = pages.join(found, KEY, "left_anti").join(boxed, KEY, "left_anti")
    again = some(read(ask(left, searched, "detect-again", prompts.detect_again(F.col("doc_context")), 0.3, 2048), replies.detected))
    all_json = found.unionByName(again).withColumnRenamed("figures", "one")
    both = pages.select(*KEY).join(all_json, KEY, "left").join(boxed.withColumnRenamed("figures", "two"), KEY, "left")
    return both.select(*KEY, boxes.clustered(boxes.merged(F.coalesce("one", none), F.coalesce("two", none))).alias("figures"))


def verified(pages: DataFrame, found: DataFrame, pngs: DataFrame, whole: DataFrame, ask: Caller, codec: Callable[[], images.Codec] | None = None, rounds: int = 2) -> DataFrame:
    """doc_id, page_num, crops after at most ``rounds`` of verification.

    With a codec the model sees the page with numbered outlines and every crop, and corrections that
    cut out blank paper are refused; without one it sees the page as in ``whole``.
    """
    rows = pages.join(found, KEY).withColumn("crops", boxes.crops(F.col("figures"), F.col("page_num"), F.col("width"), F.col("height")))
    rows = stored(rows.select(*KEY, "width", "height", "model", "doc_context", "crops", (F.size("crops") > 0).alias("open")))
    for k in range(rounds):
        looked = rows.filter("open")
        outlined = shown(images.for_verification(beside(looked.select(*KEY, "crops"), pngs), codec)) if codec else whole
        told = ask(looked, outlined, "verify", prompts.verify(F.col("crops"), F.col("page_num"), F.col("doc_context")), 0.1 + 0.1 * k, 2048, prompts.VERIFY_SYSTEM)
        known = rows.join(told.select(*KEY, "reply"), KEY, "left").withColumn("actions", replies.actions(F.col("reply"), F.size("crops")))
        known = known.withColumn("acts", F.col("open") & ~figures.all_accept(F.col("actions")))
        is_blank = None
        if codec:
            candidates = known.filter("acts").select(*KEY, figures.corrections(F.col("actions"), F.col("width"), F.col("height")).alias("candidates")).filter(F.size("candidates") > 0)
            known = known.join(stored(images.blank_boxes(beside(candidates, pngs), codec)), KEY, "left")
            is_blank = lambda b: F.coalesce(F.exists("blanks", lambda x: F.array(*(x[s] for s in boxes.SIDES)) == F.array(*(b[s] for s in boxes.SIDES))), F.lit(False))
        new = figures.executed(F.col("crops"), F.col("actions"), F.col("page_num"), F.col("width"), F.col("height"), is_blank)
        known = known.withColumn("new", F.when(F.col("acts"), new).otherwise(F.col("crops")))
        open_ = F.col("acts") & figures.moves_boxes(F.col("actions")) & (F.size("new") > 0)
        rows = stored(known.select(*KEY, "width", "height", "model", "doc_context", F.col("new").alias("crops"), open_.alias("open")))
    return rows.select(*KEY, "crops")


def crop_rows(crops: DataFrame) -> DataFrame:
    return crops.select(*KEY, F.posexplode("crops").alias("fig_idx", "c")).select(*KEY, "fig_idx", "c.*")


REPLIES = "md string, error string, review string, again string, again_error string, again_review string"


class _Page:
    """What is made of one page, as columns that are put together once for all waves."""

    def __init__(self) -> None:
        blank = lambda md: F.coalesce(text.is_blank(F.col(md)), F.lit(True))
        self.outline, self.tail = F.array_join("headings", "\n"), F.right("md", F.lit(stitching.CONVERT_TAIL))
        self.convert = prompts.page(F.col("page_num"), F.col("total_pages"), F.col("doc_context"), self.outline, F.col("tail"), F.col("filenames"), F.col("places"), F.col("coverage"))
        self.review = prompts.review(F.lit(_SEEN), F.col("page_num"), F.col("filenames"))
        self.key = F.sha2(F.to_json(F.struct("model", F.lit(prompts.SYSTEM), "convert_prompt", "review_prompt", "images_key")), 256)
        one, two = (replies.reviewed(F.col(md), F.col(review)) for md, review in (("md", "review"), ("again", "again_review")))
        self.again = F.col("error").isNull() & ~blank("md") & stitching.retried(one["score"], one["issues"])
        tries = {"md": F.col("md"), "error": F.col("error"), "score": one["score"]}, {"md": F.col("again"), "error": F.col("again_error"), "score": two["score"]}
        tried = F.col("again").isNotNull() | F.col("again_error").isNotNull()
        self.md = stitching.page_that_stays(F.col("page_num"), *tries, tried)
        self.attempts = F.when(F.col("error").isNotNull(), 0).when(tried, 2).otherwise(1)
        self.headings = text.tail_of(F.concat("headings", stitching.headings(F.col("md"))), stitching.OUTLINE_HEADINGS)
        request = lambda stage, when, prompt, most, system: {"stage": F.lit(stage), "prompt": F.when(when, prompt), "temperature": F.lit(0.1), "max_tokens": F.lit(most), "system": F.lit(system)}
        convert = lambda when: request("convert", when, F.col("convert_prompt"), 8192, prompts.SYSTEM)
        review = lambda md: request("review", ~blank(md), F.replace("review_prompt", F.lit(_SEEN), F.left(md, F.lit(prompts.PREVIEW))), 256, "")
        self.calls = [(convert(F.lit(True)), ("md", "error")), (review("md"), ("review", "review_error")), (convert(self.again), ("again", "again_error")), (review("again"), ("again_review", "again_review_error"))]

    def told(self, rows: DataFrame, client: Callable[[], models.ModelClient], limits: models.Limits) -> DataFrame:
        """``rows`` (with both prompts and images) with ``REPLIES``: a page's calls, one after the other, in one task.

        Nothing is asked where it could change nothing.
        """
        half = limits.of_task(2)  # transcriptions and reviews are under way at one time
        for request, names in self.calls:
            rows = models.replies(rows.withColumns(request), client, half, names)
        return rows


#: stands for what is reviewed, in a prompt that is made before it is known
_SEEN = "\x00transcribed\x00"


def transcribed(pages: DataFrame, placed: DataFrame, pictures: DataFrame, ask: Caller) -> DataFrame:
    """doc_id, page_num, md, attempts: every page transcribed, reviewed, and tried again on a low score.

    ``placed``: doc_id, page_num, filenames, places, coverage of pages that have some.
    """
    spark, no_names = pages.sparkSession, F.array().cast("array<string>")
    rows = pages.join(placed, KEY, "left").withColumns({"filenames": F.coalesce("filenames", no_names), "places": F.coalesce("places", no_names), "coverage": F.coalesce("coverage", F.lit(0))})
    rows = rows.withColumns({"wave": F.row_number().over(stitching.in_document()) - 1, "total_pages": F.count("*").over(W.partitionBy("doc_id")).cast("int")})
    rows = stored(with_keys(rows.select(*KEY, "model", "doc_context", "filenames", "places", "coverage", "wave", "total_pages"), pictures))
    waves = [n for _, n in sorted(rows.groupBy("wave").count().collect())]  # as many as the longest document has pages
    rows_of = storage.stored_by(rows, "wave")  # a wave reads no other wave's rows
    of_wave = storage.stored_by(with_images(rows.select(*KEY, "wave"), pictures), "wave")  # a wave reads no other wave's pictures
    folder, kinds = ask.folder(rows, "transcribed"), f"{', '.join(f'{k} {t}' for k, t in pages.select(*KEY).dtypes)}, md string, attempts int, headings array<string>"
    results, before, page = storage.shared_folder(spark), None, _Page()
    for k, n in enumerate(waves):
        now = rows_of(k)
        if before is None:
            now = now.withColumns({"tail": F.lit(""), "headings": no_names})
        else:
            now = now.join(before.select("doc_id", page.tail.alias("tail"), "headings"), "doc_id")
        now = now.select(*KEY, "model", "headings", "images_key", page.convert.alias("convert_prompt"), page.review.alias("review_prompt")).withColumn("request_key", page.key)
        memory = models.Memory(spark, f"{folder}/wave={k}", REPLIES)
        fresh, some = memory.without_known(now)
        fresh, limits = models.dealt(fresh, ask.limits, None if some else n)
        if fresh is not None:
            memory.add(page.told(with_images(fresh, of_wave(k)), ask.factory, limits))
        done = now.join(memory.rows(), "request_key").select(*KEY, page.md.alias("md"), page.attempts.alias("attempts"), "headings")
        observed = Observation()
        percent = text.progress_percent(F.concat(F.lit("["), (F.lit(sum(waves[:k])) + F.count(F.lit(1))).cast("string"), F.lit(f"/{sum(waves)}]")))
        done.withColumn("headings", page.headings).observe(observed, percent.alias("percent")).write.parquet(f"{results}/wave={k}")
        if ask.progress:
            ask.progress("pages", observed.get["percent"])  # measured by the job that has stored them
        before = spark.read.schema(kinds).parquet(f"{results}/wave={k}")
    return spark.createDataFrame([], kinds).drop("headings") if before is None else spark.read.schema(kinds).parquet(*(f"{results}/wave={k}" for k in range(len(waves)))).drop("headings")


def converted(pages: DataFrame, factory, stitch: bool = True, codec: Callable[[], images.Codec] | None = None, memory: str | None = None, limits: models.Limits = models.Limits(), progress: Progress | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(doc_id, md) of each document of ``pages`` (doc_id, page_num, width, height, png, model), and its crops (doc_id, page_num, filename, data).

    ``codec`` sizes images for the model, draws outlines and cuts crops; without one there are no crop
    files, and references to crops stay as they are.  ``memory``: a folder where replies are remembered
    beyond this run; ``limits``: what the model's provider is asked at most; ``progress`` hears of the
    percent of pages that each wave has stored.
    """
    ask = Caller(factory, memory, limits, progress)
    pages = stored(pages)  # rendered once, and no plan below has more of it than a file's name
    pngs, plain = pages.select(*KEY, "png"), pages.drop("png")
    whole, searched = (shown(images.sent(pages, codec, side)) for side in (images.PAGE_SIDE, images.SEARCH_SIDE))
    known = stored(with_context(plain, whole, ask))
    crops = crop_rows(verified(known, detected(known, searched, ask), pngs, whole, ask, codec))
    crops = stored(figures.without_decorative(crops, known))
    placed = figures.positions(crops, known)
    parts = transcribed(known, placed, whole, ask)
    named = placed.select(*KEY, F.col("filenames").alias("image_files"))
    parts = parts.join(named, KEY, "left").withColumn("image_files", F.coalesce("image_files", F.array().cast("array<string>")))
    parts = stored(parts.withColumn("md", stitching.with_unreferenced_images(F.col("md"), F.col("image_files"))))
    fixes = None
    if progress:
        progress("stitch", STITCHING)
    if stitch:
        bounds = stitching.boundaries(parts).filter(F.col("needs_stitch") & ~text.is_blank(F.col("curr"))).join(known.select(*KEY, "model"), KEY)
        mend = prompts.stitch(F.right("prev", F.lit(stitching.STITCH_TAIL)), F.left("curr", F.lit(stitching.STITCH_TAIL)))
        fixes = ask(bounds, None, "stitch", mend, 0.0, 4096, prompts.STITCH_SYSTEM).drop("error")
    md = stitching.image_loss_fallback(stitching.joined(parts, fixes), parts)
    if codec:
        cut = crops.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("filename", *boxes.SIDES))).alias("crops"))  # the crops of a page
        files = stored(images.crop_files(beside(cut, pngs), codec))
    else:
        files = crops.select(*KEY, "filename", F.lit(None).cast("binary").alias("data"))
    return tables.postprocessed(md, files.select("doc_id", "filename")), files


def documents(pages: DataFrame, factory, stitch: bool = True, **how) -> DataFrame:
    """doc_id, md of each document of ``pages``."""
    return converted(pages, factory, stitch, **how)[0]


def write(pages: DataFrame, factory, folder: str, codec: Callable[[], images.Codec], archive: bool = False, **how) -> None:
    """Markdown and crops of all documents, and an archive of each, to ``folder``, all or none; crops that earlier runs left are removed."""
    docs, files = converted(pages, factory, codec=codec, **how)
    rows = stored(sink.file_rows(docs, files))
    sink.write(rows.unionByName(sink.archives(rows)) if archive else rows, folder)
    if how.get("progress"):
        how["progress"]("done", 100)
