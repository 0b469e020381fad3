"""Messages, replies and streamed chunks as tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheetloom.functions.exprs import JSON_OPTIONS, bound, join_on, one_json_value, q, strip
from sheetloom.plans.lineage import materialize


def long_messages(df: DataFrame, id: str, order: str) -> DataFrame:
    """``df`` with ``position``, counted from 0 within each id by ``order``: nothing is gathered."""
    place = W.partitionBy(q(id)).orderBy(q(order))
    return df.withColumn("position", (F.row_number().over(place) - 1).cast("long"))


def _with_part(df: DataFrame, id: str, order: str, size: int) -> DataFrame:
    """``part`` by position: ``size`` rows each."""
    placed = long_messages(df, id, order)
    return placed.withColumn("part", F.floor(F.col("position") / F.lit(size)).cast("long")).drop("position")


#: Rows of an id that one task always takes; more are put together in parts.
PART_ROWS = 1 << 16


def gather_ordered(rows: DataFrame, id: str, order: str, item: Column, fold: Callable[[Column], Column],
                   merge: Callable[[Column], Column], cut: bool = False) -> DataFrame:
    """(id, value), one row per id: ``fold`` of the id's items, an array of (o, x) in order.

    No task gathers an id of more than ``PART_ROWS`` rows.  A range partitioning by id and order deals its rows to
    tasks in stretches of equal size, each task folds its stretch, and ``merge`` puts an id's folded stretches, an
    array in order, together.  Rows are counted first; ``cut`` writes them once where they are costly to make.
    """
    rows = rows.select(q(id).alias("id"), q(order).alias("o"), item.alias("x"))
    if cut:
        rows = materialize(rows)
    hot = materialize(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_ROWS))
    items = F.sort_array(F.collect_list(F.struct("o", "x")))

    def whole(part: DataFrame) -> DataFrame:
        return part.groupBy("id").agg(items.alias("__i")).select("id", fold(F.col("__i")).alias("value"))

    many = hot.agg(F.sum("n")).first()[0]
    if many is None:
        return whole(rows)
    # a given number of stretches, so that small ones aren't put together; rows of equal order are in the same one
    dealt = join_on(rows, hot, ["id"], "left_semi").repartitionByRange(-(-many // PART_ROWS), "id", "o")
    dealt = dealt.withColumn("__p", F.spark_partition_id())
    parts = dealt.groupBy("id", "__p").agg(items.alias("__i"), F.min("o").alias("__from")).select(
        "id", F.struct("__from", fold(F.col("__i")).alias("v")).alias("__part"))
    merged = parts.groupBy("id").agg(F.array_sort(F.collect_list("__part")).alias("__parts")).select(
        "id", merge(F.transform("__parts", lambda x: x["v"])).alias("value"))
    return whole(join_on(rows, hot, ["id"], "left_anti")).unionByName(merged)


def assemble_messages(df: DataFrame, conv: str, order: str, fields: Sequence[str] = ("role", "text"),
                      part_size: int | None = None) -> DataFrame:
    """Messages of a conversation as an ordered array, one row per conversation.

    For conversations without bound ``long_messages`` numbers the messages and
    gathers none; ``part_size`` cuts them into rows of that many messages each.
    """
    message = F.struct(q(order), *[q(f) for f in fields])
    if part_size is None:
        found = gather_ordered(df, conv, order, message, lambda i: F.transform(i, lambda m: m["x"]), F.flatten)
        return found.select(F.col("id").alias(conv), F.lit(0).cast("long").alias("part"), F.col("value").alias("messages"),
                            F.size("value").cast("long").alias("message_count"))
    return _with_part(df, conv, order, part_size).groupBy(q(conv), "part").agg(
        F.array_sort(F.collect_list(message)).alias("messages"), F.count(F.lit(1)).alias("message_count"))


def last_message(df: DataFrame, conv: str, order: str, text: str = "text") -> DataFrame:
    """Text of the last message."""
    return df.groupBy(q(conv)).agg(
        F.max(q(order)).alias("last_turn"), F.max_by(q(text), q(order)).alias("last_text")
    )


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Literal template with ``{name}`` slots replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def render_template(df: DataFrame, system: str, user: str, cols: Sequence[str],
                    keep: Sequence[str] = ()) -> DataFrame:
    """System and user message per row from two templates."""
    values = {c: q(c) for c in cols}
    return df.select(
        *[q(k) for k in keep],
        fill_template(system, values).alias("system_message"),
        fill_template(user, values).alias("user_message"),
    )


FENCE = "```"


def _format_paragraph(p: Column) -> Column:
    pieces = F.split(p, FENCE)
    fenced = F.transform(
        pieces,
        lambda s, i: F.when(
            i % 2 == 1, F.concat(F.lit(f"\n{FENCE}\n"), strip(s), F.lit(f"\n{FENCE}\n"))
        ).otherwise(s),
    )
    prose = F.replace(p, F.lit(". "), F.lit(".\n"))
    return strip(
        F.when(F.contains(p, F.lit(FENCE)), F.array_join(fenced, "")).otherwise(prose)
    )


def format_replies(df: DataFrame, c: str = "text", out: str = "formatted") -> DataFrame:
    """Paragraphs split on blank lines, sentences on own lines, code fences spaced."""
    paragraphs = F.split(q(c), r"\n{2,}")
    return df.withColumn(out, F.array_join(F.transform(paragraphs, _format_paragraph), "\n\n"))


THINK_HEADING = "**思考过程**：\n"
ANSWER_HEADING = "\n\n**最终回复**：\n"


def rewrite_think_tags(df: DataFrame, c: str = "text", out: str = "rewritten") -> DataFrame:
    """Reasoning tags to headings."""
    text = F.replace(q(c), F.lit("<think>"), F.lit(THINK_HEADING))
    text = F.replace(text, F.lit("</think>"), F.lit(ANSWER_HEADING))
    return df.withColumn(out, strip(text))


NO_ADVICE = "请根据验证结果手动检查数据质量"


def parse_recommendations(df: DataFrame, c: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Numbered (1-5) or dashed lines of a reply; a default row when there are none."""
    lines = F.transform(F.split(q(c), r"\n"), strip)
    marked = F.filter(lines, lambda s: s.rlike(r"^([1-5]\.|-)"))
    clean = F.filter(
        F.transform(marked, lambda s: strip(F.regexp_replace(s, r"^[0-9.\- ]+", ""))),
        lambda s: s != "",
    )
    rows = F.when(F.size(clean) > 0, clean).otherwise(F.array(F.lit(NO_ADVICE)))
    return df.select(*[q(k) for k in keep], F.posexplode(rows).alias("line_no", "recommendation"))


EVENT_SCHEMA = "struct<data:struct<id:string,content:string,finishReason:string>>"


def decode_events(df: DataFrame, c: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """Server-sent ``data: {json}`` lines to id, content and finish reason.

    Lines that are no JSON object with data are dropped.
    """
    body = strip(F.regexp_replace(q(c), r"^data:\s*", ""))
    rows = df.select(*[q(k) for k in keep], one_json_value(F.when(body.startswith("{"), body)).alias("__b"))
    # as a generated row the event is read once, not for each of its fields
    rows = rows.select(*[q(k) for k in keep], F.inline(F.array(F.from_json("__b", EVENT_SCHEMA, JSON_OPTIONS))))
    return rows.where(F.col("data").isNotNull()).select(
        *[q(k) for k in keep],
        F.col("data.id").alias("id"),
        F.col("data.content").alias("content"),
        F.col("data.finishReason").alias("finish_reason"),
    )


def _until_stop(chunks: Column) -> Column:
    """Text, number and stop of chunks (o, x) in order: those before the first stop marker, markers left out."""

    def cut_at(stop: Column) -> Column:
        kept = F.filter(chunks, lambda c: ~c["x"]["s"] & (stop.isNull() | (c["o"] < stop)))
        return bound(kept, lambda k: F.struct(F.array_join(F.transform(k, lambda c: c["x"]["c"]), "").alias("content"),
                                              F.size(k).cast("long").alias("chunks"), stop.isNotNull().alias("finished")))

    return bound(F.get(F.filter(chunks, lambda c: c["x"]["s"]), F.lit(0))["o"], cut_at)


def _until_stopped(parts: Column) -> Column:
    """Parts of a reply in order as one: what follows the first that is finished goes."""
    last = F.array_position(F.transform(parts, lambda p: p["finished"]), F.lit(True)).cast("int")
    kept = F.slice(parts, F.lit(1), F.when(last > 0, last).otherwise(F.size(parts)))
    return F.struct(F.array_join(F.transform(kept, lambda p: p["content"]), "").alias("content"),
                    F.aggregate(kept, F.lit(0).cast("long"), lambda n, p: n + p["chunks"]).alias("chunks"),
                    (last > 0).alias("finished"))


def reassemble_chunks(df: DataFrame, id: str = "id", order: str = "seq", content: str = "content",
                      finish: str = "finish_reason", part_size: int | None = None, cut: bool = True) -> DataFrame:
    """Chunk texts of each reply in order, up to its first stop marker, one row per reply.

    A reply of very many chunks is put together from stretches (see ``gather_ordered``, also for ``cut``).
    ``part_size`` cuts replies into rows of that many chunks each, by position.
    """
    stopped = F.coalesce(q(finish) == "stop", F.lit(False))
    text = F.coalesce(q(content), F.lit(""))
    if part_size is None:
        found = gather_ordered(df, id, order, F.struct(text.alias("c"), stopped.alias("s")), _until_stop, _until_stopped, cut)
        return found.select(F.col("id").alias(id), F.lit(0).cast("long").alias("part"), "value.*")
    rows = df.select(q(id), q(order), text.alias("c"), stopped.alias("s"))
    parts = _with_part(rows, id, order, part_size).groupBy(q(id), "part").agg(
        F.array_sort(F.collect_list(F.struct(q(order).alias("o"), "c", "s"))).alias("__chunks"),
        F.min(q(order)).alias("__from"),
        F.min(F.when(F.col("s"), q(order))).alias("__at"),
    )
    # the first marker of a reply from its parts, without reading the chunks again
    joined = parts.withColumn("__stop", F.min("__at").over(W.partitionBy(q(id))))
    open_end = F.col("__stop").isNull()
    kept = F.filter("__chunks", lambda x: ~x.s & (open_end | (x.o < F.col("__stop"))))
    return joined.where(open_end | (F.col("__from") <= F.col("__stop"))).select(
        q(id), "part",
        F.array_join(F.transform(kept, lambda x: x.c), "").alias("content"),
        F.size(kept).cast("long").alias("chunks"),
        F.col("__stop").isNotNull().alias("finished"),
    )
