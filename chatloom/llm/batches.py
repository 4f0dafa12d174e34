"""Deduplicating new batches against all history (problem 6).

Method: bit-difference fingerprints in rotated block tables. A message's fingerprint has 64 bits;
each letter of its folded content flips one of them. So a substituted letter changes at most two
bits, a lost or added letter one and a swap none, and copies of a message lie within ``MAX_BITS``.
The fingerprint is stored once per rotation, each time led by another of MAX_BITS + 1 blocks; two
fingerprints within MAX_BITS share at least one whole block (pigeonhole), so exact lookups on
(scope, view, rotation, block) lose no pair. Each hit is verified by Hamming distance and by text.
View 0 is the whole content (its numbers and denials must agree, so they are part of the key).
View 1, the first ``PREFIX`` letters, serves contents cut off by an ellipsis; only cut contents are
looked up there. Cut contents with fewer letters go by view 2: their first three letters, and the
fifth to eighth, one of which a slip leaves whole.

Scale: exact copies are merged into classes before anything is paired, so a message that makes up
a third of all rows is one class. Only classes whose scope holds another class are fingerprinted
and paired. A batch reads the stored classes of its own scopes, never the history's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import INVISIBLE, fold_accents, is_ascii
from chatloom.llm.scopes import with_scope
from chatloom.operators.timestamps import slash_orders
from chatloom.session import cut, small

MAX_BITS = 3
BLOCKS = MAX_BITS + 1
PREFIX = 12
#: Letters from which on a slip counts as one; shorter contents that differ are different messages.
SLIP_LETTERS = 4
#: Letters that a content cut off must still hold; and those from which on it may hold a slip.
CUT_LETTERS, CUT_SLIP_LETTERS = 3, 8

# Marks that an edit or a "read more" fold leaves at the end of a content.
EDIT_MARKS = r"(?iu)\s*(?:[<(\[‎]*\s*(?:this message was edited|mensagem editada|essa mensagem foi editada|esta mensagem foi editada|se edit[oó] este mensaje|mensaje editado|editada|editado|edited|bearbeitet)\s*[>)\]]+)\s*"
READ_MORE = r"(?iu)(?:…|\.{3,})\s*(?:ler mais|leia mais|read more|leer m[aá]s|ver mais|see more|ver m[aá]s)?\s*$"
# Words that turn a statement into its opposite (folded).
NEGATIONS = ["nao", "no", "not", "nunca", "never", "jamais", "nem", "ni", "sem", "sin", "without", "nada", "nothing", "ninguem", "nadie", "nobody", "t", "cant", "cannot", "dont", "wont", "didnt", "isnt", "tampouco", "tampoco", "none", "neither", "nor"]


def with_content(rows: DataFrame) -> DataFrame:
    """rows plus letters (folded letters and digits without spaces), digits, denials, is_cut (ended
    by an ellipsis) of ``content``. Each step is a column of its own, so none is evaluated twice;
    a pattern runs only on texts that hold one of its marks."""
    t = F.col("__t")
    rows = rows.withColumn("__t", F.when(is_ascii(F.col("content")), F.col("content")).otherwise(F.regexp_replace(F.coalesce("content", F.lit("")), f"[{INVISIBLE}]", "")))
    rows = rows.withColumn("__t", F.coalesce("__t", F.lit("")))
    rows = rows.withColumn("__t", F.when(t.rlike(r"(?i)edit|bearbeitet"), F.regexp_replace(t, EDIT_MARKS, " ")).otherwise(t))
    rows = rows.withColumn("is_cut", (t.contains("…") | t.contains("...")) & t.rlike(READ_MORE))
    rows = rows.withColumn("__t", F.lower(F.when(F.col("is_cut"), F.regexp_replace(t, READ_MORE, "")).otherwise(t)))
    rows = rows.withColumn("__w", fold_accents(t)).withColumn("__w", F.trim(F.regexp_replace("__w", r"[^\p{L}\p{M}\p{N}]+", " ")))
    w = F.col("__w")
    denials = F.array_join(F.filter(F.split(w, " "), lambda x: x.isin(NEGATIONS)), " ")
    denied = w.rlike(rf"(?<= |^)(?:{'|'.join(NEGATIONS)})(?= |$)")
    return rows.withColumns({
        "letters": F.replace(w, F.lit(" "), F.lit("")), "digits": F.when(w.rlike(r"\p{Nd}"), F.regexp_replace(w, r"[^\p{Nd}]+", "")).otherwise(""), "denials": F.when(denied, denials).otherwise(""),
    }).drop("__t", "__w")


def fingerprint(letters: Column) -> Column:
    """64 bits; each letter flips the bit of its hash."""
    bits = F.transform(F.split(letters, ""), lambda ch: F.when(ch == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.crc32(F.encode(ch, "utf-8")), F.lit(64)).cast("int"))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def classes(rows: DataFrame) -> DataFrame:
    """One row per class of equal messages: class_id, scope, letters, digits, denials, is_cut, batch
    and row_id (the earliest batch that holds it and its smallest row there), last_batch."""
    got = rows.groupBy("class_id").agg(
        F.min(F.struct("batch_no", "row_id")).alias("first"), F.max("batch_no").alias("last_batch"),
        *[F.min(c).alias(c) for c in ("scope", "letters", "digits", "denials", "is_cut")],
    )
    return got.select("class_id", "scope", "letters", "digits", "denials", "is_cut", F.col("first.batch_no").alias("batch"), F.col("first.row_id").alias("row_id"), "last_batch")


def with_fingerprints(cls: DataFrame) -> DataFrame:
    return cls.withColumns({"fp": fingerprint(F.col("letters")), "fp_head": fingerprint(F.substring("letters", 1, PREFIX))})


def block_table(cls: DataFrame, lookup: bool = False) -> DataFrame:
    """Rotated block tables of fingerprinted classes: class_id, block; one row per view and rotation.

    cls has ``cut_here``: some class of its scope is cut; only there views 1 and 2 are stored. As a
    lookup only cut classes stand in them.
    """
    width = 64 // BLOCKS
    n, short = F.length("letters"), F.length("letters") < PREFIX
    no = F.array().cast("array<bigint>")
    lead = lambda fp, r: F.call_function("shiftrightunsigned", fp, F.lit(r * width)).bitwiseAND(F.lit((1 << width) - 1))
    whole = [F.xxhash64("scope", F.lit(0), F.lit(r), lead(F.col("fp"), r), "digits", "denials") for r in range(BLOCKS)]
    head = [F.xxhash64("scope", F.lit(1), F.lit(r), lead(F.col("fp_head"), r)) for r in range(BLOCKS)]
    front = F.xxhash64("scope", F.lit(2), F.substring("letters", 1, 3))
    piece = lambda at: F.xxhash64("scope", F.lit(3), F.substring("letters", at, 4))
    if lookup:
        cut_slots = F.when(~F.col("is_cut"), no).when(~short, F.array(*head)).otherwise(F.concat(F.array(front), F.when(n >= CUT_SLIP_LETTERS, F.array(*[piece(k) for k in (4, 5, 6)])).otherwise(no)))
    else:
        cut_slots = F.when(~F.col("cut_here"), no).otherwise(F.concat(F.array(*head), F.array(front, piece(5))))
    return cls.select("class_id", F.explode(F.concat(F.array(*whole), cut_slots)).alias("block"))


def same_text(a: str, b: str) -> Column:
    """One content apart from a slip of a letter, or one is the other cut off.

    A slip counts from SLIP_LETTERS letters on. A content cut off must hold CUT_LETTERS letters, and
    may hold a slip from CUT_SLIP_LETTERS on.
    """
    la, lb = F.col(f"{a}.letters"), F.col(f"{b}.letters")
    n = F.least(F.length(la), F.length(lb))
    bits = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp")))
    head_bits = F.bit_count(F.col(f"{a}.fp_head").bitwiseXOR(F.col(f"{b}.fp_head")))
    near = F.levenshtein(la, lb, 2)
    slip = (near == 1) | ((near == 2) & (bits == 0) & (F.length(la) == F.length(lb)))
    whole = (bits <= MAX_BITS) & (F.col(f"{a}.digits") == F.col(f"{b}.digits")) & (F.col(f"{a}.denials") == F.col(f"{b}.denials")) & ((la == lb) | ((n >= SLIP_LETTERS) & slip))
    ca, cb = F.col(f"{a}.is_cut"), F.col(f"{b}.is_cut")
    shorter_cut = (ca & (F.length(la) <= F.length(lb))) | (cb & (F.length(lb) <= F.length(la)))
    ha, hb = F.substring(la, F.lit(1), n), F.substring(lb, F.lit(1), n)
    head_digits = F.regexp_replace(ha, r"[^\p{Nd}]+", "") == F.regexp_replace(hb, r"[^\p{Nd}]+", "")
    cut_off = shorter_cut & (n >= CUT_LETTERS) & ((ha == hb) | ((n >= CUT_SLIP_LETTERS) & (head_bits <= MAX_BITS) & head_digits & F.levenshtein(ha, hb, 1).between(0, 1)))
    return whole | cut_off


def match(new: DataFrame, index: DataFrame) -> DataFrame:
    """class_id of ``new`` and ``first``: the earliest (batch, row_id) of the other index classes that
    are its message and were seen before it."""
    facts = (
        index.select("scope", "class_id", "is_cut", F.lit(False).alias("asks"))
        .unionByName(new.select("scope", "class_id", "is_cut", F.lit(True).alias("asks")))
        .groupBy("scope").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.bool_or("asks").alias("asks"), F.bool_or("is_cut").alias("cut_here"))
        .filter("asks and lo != hi").select("scope", "cut_here")
    )
    facts = cut(facts)
    n, i = (cut(with_fingerprints(t.join(small(facts), "scope"))) for t in (new, index))
    a, b = block_table(n, lookup=True).withColumnRenamed("class_id", "x"), block_table(i).withColumnRenamed("class_id", "y")
    # a class cut off may be the longer content's earlier copy or its later one
    pairs = a.join(b, "block").filter("x != y").select("x", "y")
    cuts = block_table(i, lookup=True).withColumnRenamed("class_id", "y").join(block_table(n).withColumnRenamed("class_id", "x"), "block").filter("x != y").select("x", "y")
    pairs = pairs.unionByName(cuts).distinct()
    full = pairs.join(n.alias("n"), F.col("x") == F.col("n.class_id")).join(i.alias("i"), F.col("y") == F.col("i.class_id"))
    earlier = F.struct(F.col("i.batch"), F.col("i.row_id")) < F.struct(F.col("n.batch"), F.col("n.row_id"))
    same = (F.col("n.scope") == F.col("i.scope")) & same_text("n", "i")
    return full.filter(earlier & same).groupBy(F.col("x").alias("class_id")).agg(F.min(F.struct(F.col("i.batch").alias("batch"), F.col("i.row_id").alias("row_id"))).alias("first"))


ROW = ("row_id", "batch_no", "source_zip", "timestamp", "sender", "content")


def text_rows(parsed: DataFrame) -> DataFrame:
    """Text rows with id and batch."""
    return parsed.filter("type = 'text' and row_id is not null and batch_no is not null").select(*ROW)


def scoped_rows(texts: DataFrame, archives: DataFrame, options: DataFrame, *, evidence: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """Text rows with scope; rows without sender, time or chat are left out."""
    return cut(with_scope(texts, evidence, archives, options, orders=orders).select("row_id", "batch_no", "scope", "content")).filter("scope is not null")


def message_rows(scoped: DataFrame) -> DataFrame:
    """scoped_rows with class_id and what it stands for."""
    rows = with_content(scoped)
    rows = rows.withColumn("class_id", F.xxhash64("scope", "letters", F.col("denials"), F.col("is_cut"))).select(
        "row_id", "batch_no", "scope", "letters", "digits", "denials", "is_cut", "class_id"
    )
    return cut(rows)


def find_repeats(parsed: DataFrame, archives: DataFrame, options: DataFrame) -> DataFrame:
    """row_id_a, row_id_b for every text row that repeats a message of an earlier batch.

    All batches are looked up at once: each class that a later batch holds looks for classes seen
    before it, those of batch 0 too. A scope that only one batch holds can repeat nothing, so its
    contents are not looked at.
    """
    scoped = scoped_rows(text_rows(parsed), archives, options, evidence=parsed)
    spans = scoped.groupBy("scope").agg(F.min("batch_no").alias("lo"), F.max("batch_no").alias("hi")).filter("lo < hi").select("scope")
    rows = message_rows(scoped.join(small(cut(spans)), "scope", "left_semi"))
    cls = cut(classes(rows))
    best = match(cls.filter("last_batch > 0"), cls)
    own = cls.filter("last_batch > 0").select("class_id", "last_batch", F.struct("batch", "row_id").alias("own")).join(best, "class_id", "left")
    own = own.select("class_id", "last_batch", F.least(F.col("own"), F.coalesce("first", "own")).alias("first")).filter("last_batch > first.batch").drop("last_batch")
    hit = rows.filter("batch_no > 0").select("row_id", "batch_no", "class_id").join(own, "class_id").filter("batch_no > first.batch")
    return hit.select(F.col("first.row_id").alias("row_id_a"), F.col("row_id").alias("row_id_b"))


@dataclass
class History:
    """What is kept of all accepted batches.

    classes: one row per different message; orders: each export's slash-date votes so far; held:
    text rows whose slash dates can still be read both ways. Held rows are put into the lookup under
    the order known at the time and join the classes for good once their export is decided.
    """

    classes: DataFrame
    orders: DataFrame
    held: DataFrame

    def write(self, root: str) -> None:
        for name in ("classes", "orders", "held"):
            getattr(self, name).write.parquet(f"{root}/{name}")

    @classmethod
    def read(cls, spark, root: str) -> History:  # noqa: ANN001
        return cls(*(spark.read.parquet(f"{root}/{n}") for n in ("classes", "orders", "held")))


def _merged(classes_: DataFrame, more: DataFrame) -> DataFrame:
    """Class rows of two sources as one row a class."""
    key = F.struct("batch", "row_id")
    rest = [F.min(c).alias(c) for c in ("scope", "letters", "digits", "denials", "is_cut")]
    got = classes_.unionByName(more).groupBy("class_id").agg(F.min(key).alias("f"), F.max("last_batch").alias("last_batch"), *rest)
    return got.select("class_id", "scope", "letters", "digits", "denials", "is_cut", "f.batch", "f.row_id", "last_batch")


def ingest_batch(batch: DataFrame, history: History | None, archives: DataFrame, options: DataFrame) -> tuple[DataFrame, History]:
    """(repeats, history with the batch) of one batch of parsed rows; batches come in order.

    The accepted rows are never read again but for held ones. Answers follow the slash-date votes of
    this and all earlier batches: they equal find_repeats over the whole table unless a later batch
    decides an export's order; then the rows held of it move, answers given before stand.
    """
    spark = batch.sparkSession
    orders = slash_orders(batch)
    if history is not None:
        orders = history.orders.unionByName(orders).groupBy("source_zip").agg(F.bool_and("dm").alias("dm"), F.bool_and("md").alias("md"))
    orders = cut(orders)
    told = options.groupBy("source_zip").agg(F.min(F.struct("date_format", "timezone"))["date_format"].alias("df")).filter("df in ('DD/MM', 'MM/DD')").select("source_zip")
    undecided = orders.filter("dm and md").select("source_zip").join(told, "source_zip", "left_anti")
    texts = text_rows(batch)
    old = history.held if history is not None else spark.createDataFrame([], texts.schema)
    both = cut(texts.withColumn("is_new", F.lit(True)).unionByName(old.withColumn("is_new", F.lit(False))).withColumn("open", F.contains(F.coalesce("timestamp", F.lit("")), F.lit("/"))))
    both = cut(both.join(small(undecided.withColumn("u", F.lit(True))), "source_zip", "left").withColumn("held", F.col("open") & F.col("u").isNotNull()).drop("u", "open"))
    rows = message_rows(scoped_rows(both.select(*ROW), archives, options, orders=orders))
    flags = both.select("row_id", "is_new", "held")
    rows = cut(rows.join(flags, "row_id"))
    cls = cut(classes(rows.filter("is_new")))
    held_before = classes(rows.filter("not is_new"))
    known = held_before if history is None else _merged(history.classes, held_before)
    here = cls.select("scope").distinct()
    known = cut(known.join(here, "scope", "left_semi"))
    best = match(cls, known)
    first = cls.select("class_id").join(known.select("class_id", F.struct("batch", "row_id").alias("known")), "class_id", "left").join(best, "class_id", "left")
    first = first.select("class_id", F.least("known", "first").alias("first")).filter("first is not null")
    hit = rows.filter("is_new").select("row_id", "batch_no", "class_id").join(first, "class_id").filter("batch_no > first.batch")
    settled = classes(rows.filter("not held"))
    kept = History(
        cut(settled if history is None else _merged(history.classes, settled)), orders, cut(both.filter("held").select(*ROW)),
    )
    return cut(hit.select(F.col("first.row_id").alias("row_id_a"), F.col("row_id").alias("row_id_b"))), kept


def find_repeats_by_batch(parsed: DataFrame, archives: DataFrame, options: DataFrame) -> DataFrame:
    """find_repeats as a run of batches would give it: each in turn through ingest_batch. The loop is
    over batch numbers, of which a table holds few."""
    numbers = sorted(r["batch_no"] for r in parsed.select("batch_no").filter("batch_no is not null").distinct().collect())
    history, out = None, None
    for b in numbers:
        hits, history = ingest_batch(parsed.filter(F.col("batch_no") == b), history, archives, options)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else parsed.select(F.col("row_id").alias("row_id_a"), F.col("row_id").alias("row_id_b")).limit(0)
