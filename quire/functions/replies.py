"""Model replies as column expressions: tolerant JSON, box comments, reviews, chat messages.

JSON is read as VARIANT, element by element, so one bad element spoils no other.  Against a strict
parser: a reply with NaN or with one key twice in an object counts as unreadable, and text after the
closing bracket is refused here by its last character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import boxes, text


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _elements(v: Column) -> Column:
    """The elements of a variant that is an array; null for anything else."""
    return boxes.let(v, lambda v: F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")))


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _string(v: Column) -> Column:
    """The text of a string, number or true; empty for null, false, zero and empty texts."""
    return boxes.let(F.try_variant_get(v, "$", "string"), lambda got: F.when(got.isNull() | got.isin("false", "0", "0.0", "[]", "{}", "null"), "").otherwise(got))


def _numbers(v: Column) -> Column:
    """Four doubles from a variant array of numbers (true counts as 1); null for anything else."""
    number = lambda e: _kind(e).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$")
    value = lambda e: F.coalesce(F.try_variant_get(e, "$", "double"), F.try_variant_get(e, "$", "boolean").cast("double"))
    return boxes.let(_elements(v), lambda items: F.when((F.size(items) == 4) & F.forall(items, number), F.transform(items, value)))


def _json(raw: Column) -> Column:
    return boxes.let(text.strip(raw), lambda body: F.when(body.rlike(r"[\]}\"0-9a-z]\z"), F.try_parse_json(body)))


def _box(numbers: Column) -> Column:
    return boxes.box(*(F.get(numbers, F.lit(i)) for i in range(4)))


def detected(reply: Column, width: Column, height: Column) -> Column:
    """Figures of a detection reply: ``bbox`` in thousandths, or else ``bbox_2d`` in pixels."""
    items = _elements(_json(text.without_json_fence(reply)))

    def figure(item: Column) -> Column:
        own, pixels = _member(item, "bbox"), _member(item, "bbox_2d")
        told = boxes.let(_string(_member(item, "desc")), lambda d: F.when(d != "", d).otherwise(_string(_member(item, "label"))))
        of = lambda n: boxes.let(boxes.to_thousandths(_box(n), width, height, own.isNull()), lambda b: F.struct(*(b[s].alias(s) for s in boxes.SIDES), told.alias("desc")))
        return F.when(_kind(item).startswith("OBJECT"), boxes.let(_numbers(F.coalesce(own, pixels)), lambda n: F.when(n.isNotNull(), of(n))))

    found = F.filter(F.transform(items, figure), lambda f: f.isNotNull())
    return F.coalesce(found, F.array().cast(f"array<{boxes.FIGURE}>"))


def commented(reply: Column, width: Column, height: Column) -> Column:
    """Figures of ``<!-- Image (a,b,c,d) -->`` comments, in pixels; exact repeats once."""
    body = text.without_markdown_fence(reply)
    inside = F.regexp_extract_all(body, F.lit(rf"(?i)<!--{text.B}*Image{text.B}*\(([^)]+)\){text.B}*-->"), F.lit(1))
    numbers = F.filter(F.transform(inside, lambda s: F.transform(F.split(s, ","), lambda p: text.strip(p).try_cast("double"))), lambda a: (F.size(a) == 4) & F.forall(a, lambda x: x.isNotNull()))

    def figure(n: Column) -> Column:
        return boxes.let(boxes.to_thousandths(_box(n), width, height, F.lit(True)), lambda b: F.struct(*(b[s].alias(s) for s in boxes.SIDES), F.lit("").alias("desc")))

    same = lambda a, b: F.array(*(F.rint(a[s]) for s in boxes.SIDES)) == F.array(*(F.rint(b[s]) for s in boxes.SIDES))
    return boxes.keep_first(F.transform(numbers, figure), boxes.FIGURE, same)


def reviewed(md: Column, reply: Column) -> Column:
    """Score and issues of a page review; 80 and none where the reply cannot be read."""
    nothing = F.array().cast("array<string>")
    unread = F.struct(F.lit(80).alias("score"), nothing.alias("issues"))

    def parts(v: Column) -> Column:
        return F.struct(_kind(v).alias("kind"), _member(v, "score").alias("score"), _member(v, "issues").alias("issues"))

    def read(p: Column) -> Column:
        score = F.when(p["score"].isNull(), 80).otherwise(F.coalesce(F.try_variant_get(p["score"], "$", "double"), F.try_variant_get(p["score"], "$", "string").try_cast("int")).cast("int"))
        issues = F.when(p["issues"].isNull(), nothing).otherwise(F.transform(_elements(p["issues"]), lambda e: F.try_variant_get(e, "$", "string")))
        return F.when(p["kind"].startswith("OBJECT"), F.struct(score.alias("score"), issues.alias("issues")))

    parsed = lambda body: F.coalesce(_json(body), _json(F.replace(body, F.lit("\\"), F.lit("\\\\"))))
    told = boxes.let(boxes.let(boxes.let(text.without_json_fence(reply), parsed), parts), read)
    known = boxes.let(told, lambda r: F.when(r["score"].isNotNull() & r["issues"].isNotNull(), r).otherwise(unread))
    return F.when(md.isNull() | text.is_blank(md), F.struct(F.lit(0).alias("score"), F.array(F.lit("空输出")).alias("issues"))).otherwise(known)


ACTION = "struct<index:int,action:string,bbox:array<double>,regions:array<struct<bbox:array<double>,desc:string>>,reason:string>"


def actions(reply: Column, n_crops: Column) -> Column:
    """Verification actions; all crops accepted where the reply is no array."""
    items = _elements(_json(text.without_json_fence(reply)))
    region = lambda r: F.struct(_numbers(_member(r, "bbox")).alias("bbox"), F.coalesce(F.try_variant_get(r, "$.desc", "string"), F.lit("")).alias("desc"))

    def action(a: Column) -> Column:
        return F.struct(
            F.coalesce(F.try_variant_get(a, "$.index", "int"), F.lit(0)).alias("index"),
            F.coalesce(F.try_variant_get(a, "$.action", "string"), F.lit("accept")).alias("action"),
            _numbers(_member(a, "bbox")).alias("bbox"),
            F.transform(_elements(_member(a, "regions")), region).alias("regions"),
            F.coalesce(F.try_variant_get(a, "$.reason", "string"), F.lit("")).alias("reason"),
        )

    accept = F.transform(F.sequence(F.lit(1), n_crops), lambda i: F.struct(i.cast("int").alias("index"), F.lit("accept").alias("action"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("array<struct<bbox:array<double>,desc:string>>").alias("regions"), F.lit("").alias("reason")))
    nothing = F.array().cast(f"array<{ACTION}>")
    given = lambda found: F.transform(F.filter(found, lambda a: _kind(a).startswith("OBJECT")), action)
    return boxes.let(items, lambda found: F.when(found.isNotNull(), given(found)).when(n_crops > 0, accept).otherwise(nothing))


def flattened(messages: Column) -> Column:
    """Chat messages (role, parts of type, text, url) in the other provider's shape.

    System texts become one instruction, assistants are called model, data URLs are decoded, other
    URLs and undecodable data are left out, and so are messages with nothing left.
    """
    system = F.filter(messages, lambda m: m["role"] == "system")
    words = lambda m: F.array_join(F.filter(F.transform(m["parts"], lambda p: p["text"]), lambda t: t != ""), "\n")
    instruction = F.array_join(F.filter(F.transform(system, words), lambda t: t != ""), "\n")

    def part(p: Column) -> Column:
        url = p["url"]
        head = F.substring_index(url, ",", 1)
        mime = F.regexp_extract(head, r"^data:([^;]*)", 1)
        data = F.when(url.rlike(r"(?s)^data:.*,"), F.try_to_binary(F.regexp_extract(url, r"(?s),(.*)\z", 1), F.lit("base64")))
        return F.struct(F.when(p["type"] != "image_url", p["text"]).alias("text"), F.when(data.isNotNull(), F.when(mime == "", "image/png").otherwise(mime)).alias("mime_type"), data.alias("data"))

    def message(m: Column) -> Column:
        parts = F.filter(F.transform(m["parts"], part), lambda p: (p["text"] != "") | p["data"].isNotNull())
        return F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), parts.alias("parts"))

    rest = F.filter(F.transform(F.filter(messages, lambda m: m["role"] != "system"), message), lambda m: F.size(m["parts"]) > 0)
    return F.struct(instruction.alias("system_instruction"), rest.alias("contents"))
