"""Archives to documents: the end-to-end batch, and its options."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import chat
from chatloom.functions.periods import lenient_date, period_label
from chatloom.operators import dedup, media, parser, render, store
from chatloom.schemas import CONTACTS, LAYOUTS, MEDIA, MESSAGES, RUNS, SPLITS, WARNINGS
from chatloom.session import cut, small
from chatloom.sources import archives as src
from chatloom.sources import files

log = logging.getLogger("chatloom")
INDEX = MESSAGES + ", content string, is_media_omitted boolean"
STAGING = "_medias_staging"


@dataclass
class IngestOptions:
    input: str = "./to-ingest/"
    output: str = "./evidence/"
    split: str = "1w"
    layout: str = "by-period"
    media: str = "none"
    date_format: str | None = None
    timezone: str = "America/Sao_Paulo"
    self_name: str | None = None
    contact: str | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    concurrency: int = 3
    disclaimer: str | None = None
    policy: str = "omitted_only"
    force: bool = False
    regenerate: bool = False
    dry_run: bool = False
    quiet: bool = False
    verbose: bool = False

    def __post_init__(self) -> None:
        for value, allowed, name in ((self.split, SPLITS, "split"), (self.layout, LAYOUTS, "layout"), (self.media, ("none", "audio", "images", "all"), "media"), (self.policy, dedup.POLICIES, "policy")):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.date_format not in (None, "DD/MM", "MM/DD"):
            raise ValueError("date_format must be DD/MM or MM/DD")
        if self.concurrency < 1:
            raise ValueError("concurrency must be at least 1")


def parse_options(argv: list[str]) -> IngestOptions:
    """Options of a command line; unknown flags are ignored."""
    p = argparse.ArgumentParser(add_help=False)
    for name in ("input", "output", "split", "layout", "media", "date-format", "timezone", "self", "contact", "policy", "disclaimer"):
        p.add_argument(f"--{name}")
    p.add_argument("--concurrency", type=int)
    p.add_argument("--alias", action="append", default=[])
    for name in ("force", "regenerate", "dry-run", "quiet", "verbose"):
        p.add_argument(f"--{name}", action="store_true")
    a, _ = p.parse_known_args(argv)
    aliases = {}
    for x in a.alias:
        if "=" not in x:
            raise ValueError(f"alias {x!r} has no =")
        k, v = x.split("=", 1)
        aliases[k] = v
    named = {k: v for k, v in vars(a).items() if v is not None and k not in ("alias", "self")}
    return IngestOptions(**named, self_name=a.self, aliases=aliases)


def relabel(messages: DataFrame, split: str) -> DataFrame:
    """messages with every period computed again."""
    return messages.withColumn("period", period_label(lenient_date(F.col("timestamp")), split))


def stored_config(state: dict[str, DataFrame], opts: IngestOptions) -> tuple[dict[str, str], str | None]:
    """(aliases, self) of the index with this run's on top: an alias given again replaces the stored
    one, self is replaced if it is given."""
    was = state["config"].first() if "config" in state else None
    aliases = {k: v for k, v in ((was["aliases"] if was else None) or {}).items() if k}
    return aliases | opts.aliases, opts.self_name or (was["self"] if was else None)


def merge_run(index: DataFrame, contacts: DataFrame, parsed: DataFrame, info: DataFrame, policy: str, split: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, str]]:
    """(index, contacts, acts, source_zip -> contact) after all archives of a run, merged in order by
    one fold. parsed: rows of dedup_archive; info: one row per archive."""
    went = store.resolve_contacts(index, parsed, info)
    spark = parsed.sparkSession
    to = small(spark.createDataFrame(list(went.items()), "source_zip string, contact string"))
    new = cut(parsed.join(small(info.select("source_zip", F.col("zip_order").alias("archive"))), "source_zip").join(to, "source_zip"))
    acts = cut(store.merge_archives(index, new, policy))
    index = cut(store.apply_merge(index, new, acts, split))
    told = info.join(to, "source_zip").groupBy("contact").agg(
        F.max_by(F.when(F.col("is_group"), "group").otherwise("individual"), "zip_order").alias("type"),
        F.transform(F.array_sort(F.collect_list(F.struct("zip_order", "source_zip"))), lambda x: x["source_zip"]).alias("zips"),
        F.max_by("date_format", "zip_order").alias("date_format"), F.max_by("encoding", "zip_order").alias("encoding"),
    )
    kept = contacts.join(told.select("contact"), "contact", "left_anti")
    had = contacts.select("contact", F.col("source_zips").alias("had"))
    none = F.array().cast("array<string>")
    fresh = told.join(had, "contact", "left").select(
        "contact", "type", F.array_distinct(F.concat(F.coalesce("had", none), "zips")).alias("source_zips"), F.lit(0).cast("long").alias("message_count"),
        chat.sanitize_name(F.col("contact")).alias("sanitized_name"), "date_format", "encoding",
    )
    return index, cut(kept.unionByName(fresh)), acts, went


def ingest(spark: SparkSession, opts: IngestOptions, audio: media.Extractor = media.offline_audio, image: media.Extractor = media.offline_image) -> dict[str, int]:
    """Run the batch: scan, parse, dedup, merge in archive order, media, render, save. Returns counters.

    All archives of a run go through the same plans; nothing loops over archives but the choice of
    their contacts, which takes small counts. audio and image are the models (with opts.media).
    """
    logging.getLogger("chatloom").setLevel(logging.ERROR if opts.quiet else logging.DEBUG if opts.verbose else logging.INFO)
    root = files.join(opts.output, ".index")
    state = store.load_snapshot(spark, root) or {}
    empty = lambda schema: spark.createDataFrame([], schema)
    index, contacts = state.get("messages", empty(INDEX)), state.get("contacts", empty(CONTACTS))
    known, warned, runs = state.get("media", empty(MEDIA)), state.get("warnings", empty(WARNINGS)), state.get("runs", empty(RUNS))
    if "config" in state:
        was = state["config"].first()
        if (was["split"], was["layout"]) != (opts.split, opts.layout):
            if not opts.force:
                raise ValueError("split or layout differ from the index; use force to change them")
            index = relabel(index, opts.split)
    aliases, me = stored_config(state, opts)
    stats = dict.fromkeys(("archives", "failed", "added", "skipped", "upgraded", "replaced", "warnings"), 0)
    touched: set[str] | None = None
    if not opts.regenerate:
        zips = src.scan_archives(spark, opts.input)
        got = cut(src.extract_archives(zips))
        stats["failed"] = got.filter("error is not null").count()
        good = got.filter("error is null")
        lines = cut(parser.log_lines(good))
        parsed = cut(dedup.dedup_archive(parser.parse_lines(lines, opts.date_format), opts.policy))
        formats = parser.detect_formats(lines).withColumn("date_format", F.coalesce(F.lit(opts.date_format), "date_format"))
        early = cut(parser.warnings(lines))
        stats["warnings"] = early.count()
        info = good.select("source_zip", "zip_order", "contact_name", "encoding").join(formats, "source_zip", "left").join(store.group_test(parsed), "source_zip", "left")
        info = cut(info)
        index, contacts, acts, went = merge_run(index, contacts, parsed, info, opts.policy, opts.split)
        touched = set(went.values())
        stats["archives"] = len(went)
        for r in acts.groupBy("action").count().collect():
            if r["action"] in stats:
                stats[r["action"]] += r["count"]
        for name, contact in went.items():
            log.debug("%s -> %s", name, contact)
        named = cut(src.media_names(src.media_entries(zips)))
        to = small(spark.createDataFrame(list(went.items()), "source_zip string, contact string"))
        known = cut(store.register_media(known, named.join(to, "source_zip")))
        warned = warned.join(early.select("source_zip").distinct(), "source_zip", "left_anti").unionByName(early.select(*[c.split()[0] for c in WARNINGS.split(", ")]))
        if not opts.dry_run:
            src.stage_media(zips, named.join(to.select("source_zip"), "source_zip", "left_semi"), files.join(opts.output, STAGING)).agg(F.count("*")).collect()
    if me is None:
        hit = store.detect_self(index.select("contact", "sender")).first()
        me = hit["self_name"] if hit else None
    counts = store.contact_counts(index).select("contact", "message_count")
    contacts = cut(contacts.drop("message_count").join(counts, "contact", "left").select(*[f"{c.split()[0]}" for c in CONTACTS.split(", ")]))
    pending = known.filter(F.col("status").isin("pending", "failed"))
    if opts.dry_run:
        stats |= {"contacts": len(touched or ()), "periods": store.contact_periods(index.filter(F.col("contact").isin(sorted(touched or ())))).count(), "pending_media": pending.count()}
        return stats
    if opts.media != "none":
        key = F.to_json(F.struct("contact", "filename"))
        items = cut(pending.select("contact", "filename", "status", key.alias("key"), F.concat(F.lit(files.join(opts.output, STAGING) + "/"), "stored_name").alias("path")))
        results = cut(media.process_media(items, opts.media, opts.concurrency, audio, image).join(items.select("key", "contact", "filename"), "key"))
        known = cut(store.update_media(known, results))
        for r in results.groupBy("status").count().collect():
            stats[f"media_{r['status']}"] = r["count"]
    scope = {opts.contact} if opts.contact is not None else touched
    shown = index if scope is None else index.join(small(spark.createDataFrame([(c,) for c in sorted(scope)], "contact string")), "contact", "left_semi")
    docs = documents(shown, contacts, known, opts, me, aliases)
    stats["documents"] = src.write_documents(docs, opts.output, render.output_path(opts.layout))
    stats["placed"] = src.place_media(placement(shown, contacts, known, opts))
    conf = spark.createDataFrame([(opts.split, opts.layout, opts.timezone, me, aliases or {"": ""})], "split string, layout string, timezone string, self string, aliases map<string,string>")
    run = spark.createDataFrame([tuple(stats[c.split()[0]] for c in RUNS.split(", ")[:-1])], RUNS.rsplit(", ", 1)[0]).withColumn("at", F.current_timestamp())
    store.save_snapshot({"messages": index, "contacts": contacts, "config": conf, "media": known, "warnings": warned, "runs": runs.unionByName(run)}, root)
    return stats


def placement(messages: DataFrame, contacts: DataFrame, known: DataFrame, opts: IngestOptions) -> DataFrame:
    """source, target of the staged files that the documents of ``messages`` show."""
    want = src.media_placement(messages, known.select("contact", F.col("filename").alias("media_file")), None)
    want = want.join(known.select("contact", F.col("filename").alias("media_file"), "stored_name"), ["contact", "media_file"]).join(contacts.select("contact", "sanitized_name"), "contact")
    folder = F.regexp_replace(render.output_path(opts.layout), r"/[^/]+$", "")
    at = lambda *parts: F.concat_ws("/", F.lit(opts.output.rstrip("/")), *parts)
    return want.select(at(F.lit(STAGING), F.col("stored_name")).alias("source"), at(folder, F.lit("medias"), F.col("stored_name")).alias("target"))


def documents(index: DataFrame, contacts: DataFrame, known: DataFrame, opts: IngestOptions, me: str | None, aliases: dict[str, str]) -> DataFrame:
    """The period documents of an index, with what was made of its media."""
    table = F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv])
    rows = index.join(contacts.select("contact", (F.col("type") == "group").alias("is_group")), "contact")
    # two files of one name may lie in one folder, so documents show the names they are stored under
    rows = store.attach_media(rows, known).drop("media_file").withColumnRenamed("stored_name", "media_file")
    return render.period_documents(rows, contacts, chat.display_sender(F.col("sender"), table, F.col("is_group"), F.lit(me).cast("string")), opts.disclaimer)
