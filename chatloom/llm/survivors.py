"""Best representative of each duplicate group (problem 4).

Method: a latent two-sided quality model. Each export is a source that, for the messages it holds,
asserts values (a media file, a caption) or keeps silent; the list of files really present in its
archive is a second source, which bears out the files its messages name or doesn't.
Expectation-maximisation infers each source's sensitivity (true values it asserts) and specificity
(false values it keeps out) and each value's probability of being true, until no probability moves
by more than ``TOLERANCE``. Fields with several values keep every value judged true; single fields
come from the copy that has them best among those with a true value.

Scale: silence is never spelled out as rows. Sums over a group's sources and corrections for the
asserted values give the same likelihood, so an iteration is linear in the number of assertions,
also for a group that holds a third of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import INVISIBLE, WS, fold_accents
from chatloom.llm.scopes import with_scope
from chatloom.session import BROADCAST_ROWS, cut

#: Beta priors of sensitivity and of specificity: (successes, failures). A list of files seldom holds
#: a file that isn't there, but lacks many, as exports leave media out.
SENSITIVITY, SPECIFICITY, PRIOR = (4.0, 2.0), (9.0, 1.0), 0.5
LIST_SENSITIVITY, LIST_SPECIFICITY = (1.0, 1.0), (999.0, 1.0)
#: The model has settled when no probability moves by more than this; at the latest after ROUNDS.
TOLERANCE, ROUNDS = 0.02, 8
LIST = "\0list"
#: Letters that a caption cut short must hold to count as a copy of a longer one.
HEAD = 12


def media_rows(parsed: DataFrame, archives: DataFrame, options: DataFrame) -> DataFrame:
    """Media rows with ``group_id``: one message per scope, or per file where a scope names several.

    A row without a file in a scope with several files goes to the file whose caption it shares;
    if there is none it stays alone.
    """
    p = parsed.filter("type = 'media' and row_id is not null").select("row_id", "source_zip", "timestamp", "sender", "content", "media_file", "is_media_omitted", "subtype")
    rows = with_scope(p, parsed, archives, options, ("exported_at", "media_files"))
    name = F.lower(F.trim(F.regexp_replace("media_file", f"[{INVISIBLE}]", "")))
    rows = rows.withColumn("file", F.when(name != "", name)).withColumn(
        "listed", F.col("file").isNotNull() & F.coalesce(F.exists("media_files", lambda f: F.lower(f) == F.col("file")), F.lit(False))
    )
    text = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), f"[{INVISIBLE}]", ""), rf"^[{WS}]+|[{WS}]+\z", "")
    caption = F.regexp_replace(F.lower(fold_accents(text)), r"[^\p{L}\p{M}\p{N}]+", "")
    rows = rows.withColumn("text", text).withColumn("text_length", F.length(text)).withColumn("caption", caption)
    rows = cut(rows.select("row_id", "source_zip", "scope", "file", "listed", "text", "text_length", "caption", "exported_at", "content", "media_file", "is_media_omitted", "subtype")).filter("scope is not null")
    per = rows.groupBy("scope").agg(F.min("file").alias("lo"), F.max("file").alias("hi"))
    several = F.col("lo") != F.col("hi")
    named = rows.filter("file is not null and caption != ''").join(per.filter("lo != hi"), "scope", "left_semi").select("scope", _head(F.col("caption")).alias("head"), "file", F.col("caption").alias("c")).distinct()
    bare = rows.filter("file is null and caption != ''").select("scope", _head(F.col("caption")).alias("head"), "caption").distinct()
    hit = bare.join(named, ["scope", "head"]).filter(F.startswith("caption", "c") | F.startswith("c", "caption")).withColumn("exact", F.col("caption") == F.col("c"))
    # the same caption decides before a copy cut short
    hit = hit.groupBy("scope", "caption").agg(*[f(F.when(w, F.col("file"))).alias(n) for n, f, w in (("lo_e", F.min, F.col("exact")), ("hi_e", F.max, F.col("exact")), ("lo_p", F.min, F.lit(True)), ("hi_p", F.max, F.lit(True)))])
    hit = hit.select("scope", "caption", F.when(F.col("lo_e").isNotNull(), F.when(F.col("lo_e") == F.col("hi_e"), F.col("lo_e"))).when(F.col("lo_p") == F.col("hi_p"), F.col("lo_p")).alias("by_caption"))
    rows = rows.join(per, "scope").join(hit, ["scope", "caption"], "left")
    part = F.when(~F.coalesce(several, F.lit(False)), F.lit("")).otherwise(F.coalesce("file", "by_caption", F.concat(F.lit("\0row "), F.col("row_id").cast("string"))))
    rows = cut(rows.withColumn("group_id", F.concat_ws("|", "scope", part)).drop("lo", "hi", "by_caption"))
    return rows.join(whole_captions(rows), ["group_id", "caption"], "left").withColumn("caption", F.coalesce("whole", "caption")).drop("whole")


def _head(caption: Column) -> Column:
    return F.substring(caption, 1, HEAD)


def whole_captions(rows: DataFrame) -> DataFrame:
    """group_id, caption, whole: copies cut short and the longest caption of their group they begin
    (the smallest of equally long ones)."""
    c = rows.filter("caption != ''").select("group_id", "caption", _head(F.col("caption")).alias("head")).distinct()
    longer = c.withColumnRenamed("caption", "whole")
    hit = c.filter(F.length("caption") >= HEAD).join(longer, ["group_id", "head"]).filter((F.length("whole") > F.length("caption")) & F.startswith("whole", "caption"))
    return hit.groupBy("group_id", "caption").agg(F.min(F.struct(-F.length("whole"), "whole"))["whole"].alias("whole"))


def assertions(rows: DataFrame, fields: tuple[str, ...] = ("file", "caption")) -> tuple[DataFrame, DataFrame]:
    """(claims, coverage). claims: group_id, field, value, source: what each source asserts, repeats
    once. coverage: the distinct group_id, field, source that could assert something.

    A message without its file says nothing about which file it was, so it doesn't cover the field;
    an archive's list covers a group whose messages name a file.
    """
    one = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col("source_zip").alias("source"), F.lit(True).alias("says")) for f in fields]
    listed = F.struct(F.lit("file").alias("field"), F.col("file").alias("value"), F.concat("source_zip", F.lit(LIST)).alias("source"), F.col("listed").alias("says"))
    a = rows.select("group_id", F.explode(F.array(*one, *([listed] if "file" in fields else []))).alias("a")).select("group_id", "a.*")
    a = a.groupBy("group_id", "field", "value", "source").agg(F.bool_or("says").alias("says"))
    covers = a.filter((F.col("field") != "file") | F.col("value").isNotNull()).select("group_id", "field", "source").distinct()
    return a.filter("says and value is not null and value != ''").drop("says"), covers


def truths(claims: DataFrame, coverage: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(values, sources): probability of each (group_id, field, value); sensitivity and specificity
    of each source. Stops when no probability moves by more than ``tolerance``."""
    clip = lambda c: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    pick = lambda lst, msg, i: F.when(F.col("source").endswith(LIST), lst[i]).otherwise(msg[i])
    se = [pick(LIST_SENSITIVITY, SENSITIVITY, i) for i in (0, 1)]
    sp = [pick(LIST_SPECIFICITY, SPECIFICITY, i) for i in (0, 1)]
    # the rounds go over digests of 16 bytes in place of names and captions
    digest = lambda *c: F.unhex(F.md5(F.concat_ws("\0", *c)))
    said_rows = cut(claims.select(digest("group_id", "field").alias("g"), digest("value").alias("v"), digest("source").alias("s")))
    could_rows = cut(coverage.select(digest("group_id", "field").alias("g"), digest("source").alias("s")))
    names = cut(coverage.select("source").distinct().withColumn("s", digest("source")))
    sources = cut(names.select("s", "source", (se[0] / (se[0] + se[1])).alias("sens"), (sp[0] / (sp[0] + sp[1])).alias("spec")))
    sent = F.broadcast if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda x: x
    odds, z, values = math.log(PRIOR / (1 - PRIOR)), F.lit(0.0), None
    for _ in range(rounds):
        silent = F.log((1 - F.col("sens")) / F.col("spec"))
        spoken = F.log(F.col("sens") / (1 - F.col("spec")))
        weights = sent(sources.select("s", silent.alias("silent"), (spoken - silent).alias("extra")))
        base = could_rows.join(weights, "s").groupBy("g").agg(F.sum("silent").alias("base"))
        said = said_rows.join(weights, "s").groupBy("g", "v").agg(F.sum("extra").alias("said"))
        post = 1 / (1 + F.exp(-(F.lit(odds) + F.col("base") + F.col("said"))))
        now = said.join(base, "g").select("g", "v", post.alias("p"))
        was = F.lit(0.0) if values is None else F.col("was")
        now = now if values is None else now.join(values.select("g", "v", F.col("p").alias("was")), ["g", "v"])
        values = cut(now.select("g", "v", "p", F.abs(F.col("p") - was).alias("moved")))
        mass = values.groupBy("g").agg(F.sum("p").alias("true_mass"), F.sum(1 - F.col("p")).alias("false_mass"))
        could = could_rows.join(mass, "g").groupBy("s").agg(F.sum("true_mass").alias("t"), F.sum("false_mass").alias("f"))
        did = said_rows.join(values, ["g", "v"]).groupBy("s").agg(F.sum("p").alias("dt"), F.sum(1 - F.col("p")).alias("df"))
        sources = cut(
            names.join(could, "s", "left").join(did, "s", "left").select(
                "s", "source",
                clip((F.coalesce("dt", z) + se[0]) / (F.coalesce("t", z) + se[0] + se[1])).alias("sens"),
                clip(1 - (F.coalesce("df", z) + sp[1]) / (F.coalesce("f", z) + sp[0] + sp[1])).alias("spec"),
            )
        )
        if (values.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    known = claims.select("group_id", "field", "value").distinct().withColumns({"g": digest("group_id", "field"), "v": digest("value")})
    return known.join(values, ["g", "v"]).select("group_id", "field", "value", "p"), sources.drop("s")


def _best(rows: Column, *order: Column, value: str = "row_id") -> Column:
    """``value`` of the best row under a condition: largest order, then smallest row_id."""
    place = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], (-F.col("row_id")).alias("neg"))
    return F.max_by(value, F.when(rows, place))


def survivors(parsed: DataFrame, archives: DataFrame, options: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One surviving record per group of two or more copies, built field by field.

    group_id, copies; first_row_id; media_row_id: the latest export whose named file is really there
    and judged true; text_row_id: the longest text, then the latest export. The record: media_file
    and subtype of the media row (else of the most trusted copy that has one), is_media_omitted (no
    copy has a true file), content as the text row has it, sent (source_zip of the media or text
    row). files and captions: every value judged true; trust: the mean quality of the sources.

    Captions are compared by their folded letters and put out as the best copy wrote them. Ties go to
    the smaller row_id; a null export date is earlier than any. Rows without chat, sender or readable
    time belong to no group. Empty tables give an empty result.
    """
    rows = media_rows(parsed, archives, options)
    size = rows.groupBy("group_id").agg(F.count("*").alias("copies")).filter("copies > 1")
    rows = cut(rows.join(size, "group_id"))
    claims, coverage = (cut(x) for x in assertions(rows))
    values, sources = truths(claims, coverage, rounds)
    when = F.coalesce(F.col("exported_at"), F.lit("0001-01-01").cast("timestamp"))
    written = rows.filter("caption != ''").groupBy("group_id", F.col("caption").alias("value")).agg(_best(F.lit(True), F.col("text_length"), when, value="text").alias("text")).withColumn("field", F.lit("caption"))
    judged = values.join(written, ["group_id", "field", "value"], "left").groupBy("group_id").agg(
        F.collect_set(F.when((F.col("field") == "file") & (F.col("p") >= 0.5), F.col("value"))).alias("files"),
        F.collect_set(F.when((F.col("field") == "caption") & (F.col("p") >= 0.5), F.col("text"))).alias("captions"),
    )
    quality = sources.filter(~F.col("source").endswith(LIST)).select(F.col("source").alias("source_zip"), ((F.col("sens") + F.col("spec")) / 2).alias("quality"))
    true_file = values.filter("field = 'file' and p >= 0.5").select("group_id", F.col("value").alias("file"), F.lit(True).alias("is_true"))
    rows = rows.join(true_file, ["group_id", "file"], "left").join(quality, "source_zip", "left").withColumn("quality", F.coalesce("quality", F.lit(0.5)))
    there, any_, longest = F.col("listed") & F.coalesce("is_true", F.lit(False)), F.lit(True), F.col("text_length")
    out = rows.groupBy("group_id").agg(
        F.max("copies").alias("copies"),
        F.min("row_id").alias("first_row_id"),
        _best(there, when).alias("media_row_id"),
        _best(any_, longest, when).alias("text_row_id"),
        F.coalesce(_best(there, when, value="media_file"), _best(F.col("file").isNotNull(), F.col("quality"), when, value="media_file")).alias("media_file"),
        (~F.bool_or(there)).alias("is_media_omitted"),
        F.coalesce(_best(there, when, value="subtype"), _best(F.col("subtype").isNotNull(), F.col("quality"), when, value="subtype")).alias("subtype"),
        _best(any_, longest, when, value="content").alias("content"),
        F.coalesce(_best(there, when, value="source_zip"), _best(any_, longest, when, value="source_zip")).alias("sent"),
        F.avg("quality").alias("trust"),
    )
    return out.join(judged, "group_id", "left")


def found(parsed: DataFrame, archives: DataFrame, options: DataFrame) -> DataFrame:
    return survivors(parsed, archives, options).filter("media_row_id is not null").select("first_row_id", "media_row_id", "text_row_id")
