"""A vault as a set of tables, with a method per command.

Tables are versioned Parquet directories. A command writes what it changes beside what is there, and one manifest, renamed
into place at its end, makes all of it count at once (see quillstone.store): a command that fails changes nothing,
and of two at a time the second is refused. Commands that change pages return their changes as a table
first; `approve=True` commits them.
"""

from __future__ import annotations

import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import schemas
from quillstone.functions import frontmatter
from quillstone.functions.text import content_key, dated_path, slugify, wikilinks
from quillstone.operators import claims, graph, ingest, lint, maintenance, resolution, retrieval, status
from quillstone.operators.search import SearchIndex
from quillstone.shared import stash
from quillstone.sources import vault as scans
from quillstone.store import Store

TABLES = {
    "inbox": schemas.RAW_ITEMS,
    "filed": schemas.RAW_ITEMS,
    "pages": schemas.PAGES,
    "proposals": schemas.PROPOSALS,
    "changes": schemas.CHANGES,
    "claims": schemas.CLAIMS,
    "log": schemas.LOG,
    "log_archive": schemas.LOG,
    "redirects": "from_slug string, to_slug string",
    "nodes": "id string, type string",
    "edges": schemas.EDGES,
}
#: Directories of a table above which a command that appends to it writes it anew.
MANY_PARTS = 64


def claims_bullet() -> Column:
    """A claim as a line of its subject's page."""
    since = F.when(F.col("valid_from").isNotNull(), F.concat(F.lit(" since "), F.col("valid_from").cast("string"))).otherwise("")
    return F.concat("attribute", F.lit(": "), "value", since, F.lit(" ("), F.element_at(F.split("source", "/"), -1), F.lit(")"))


def command(f):
    """A method whose changes are committed together when it returns; one that it calls is part of it."""

    @wraps(f)
    def run(self, *args, **kwargs):
        if self._began is not None:
            return f(self, *args, **kwargs)
        self._began = self._store.latest()
        self._new = {}
        try:
            out = f(self, *args, **kwargs)
            number, tables = self._began
            if self._new:
                self._store.commit(number, tables | {name: {"parts": parts, "at": number + 1} for name, parts in self._new.items()})
            return out
        finally:
            self._began = None

    return run


class Vault:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._store, self._began, self._new = Store(spark, base), None, {}
        self.search = SearchIndex(spark, f"{self.base}/search")

    def _parts(self, name: str) -> list[str]:
        if self._began is not None and name in self._new:
            return self._new[name]
        return (self._began or self._store.latest())[1].get(name, {}).get("parts", [])

    def table(self, name: str) -> DataFrame:
        """A table; raw is the inbox's and the filed and quarantined items together."""
        if name == "raw":
            return self.table("inbox").unionByName(self.table("filed"))
        return self._store.read(self._parts(name), TABLES[name])

    def live(self) -> DataFrame:
        """The pages that aren't in the archive: what the graph, health checks, upkeep and search look at."""
        return self.table("pages").where(~F.col("path").startswith(schemas.ARCHIVE))

    def _write(self, name: str, df: DataFrame) -> str:
        fields = self.spark.createDataFrame([], TABLES[name]).schema.fields
        return self._store.write(df.select(*(f.name if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields)), name)

    @command
    def _save(self, name: str, df: DataFrame) -> None:
        self._new[name] = [self._write(name, df)]

    @command
    def _append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table without writing it anew, but when it has come to be in a great many directories."""
        parts = self._parts(name)
        if len(parts) >= MANY_PARTS:
            df, parts = self.table(name).unionByName(df.select(*self.table(name).columns)), []
        self._new[name] = [*parts, self._write(name, df)]

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _log(self, skill: str, batch_id: str, rows: DataFrame) -> None:
        """rows: channel, op, path."""
        now = F.lit(datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)).cast("timestamp")
        self._append("log", rows.select(now.alias("ts"), F.lit(skill).alias("skill"), "channel", "op", "path", F.lit(batch_id).alias("batch_id")))

    # --- setting up -----------------------------------------------------------------------------

    @command
    def init(self) -> None:
        """Empty tables; refuses a directory that has a vault already."""
        if self._began[0]:
            raise FileExistsError(f"{self.base} is a vault already")
        for name, ddl in TABLES.items():
            self._save(name, self.spark.createDataFrame([], ddl))

    @command
    def load(self, root: str) -> None:
        """Take over a Markdown vault: its raw items, pages and queued proposals."""
        raw = scans.raw_items(self.spark, root)
        self._save("inbox", raw.where("state = 'inbox'"))
        self._save("filed", raw.where("state <> 'inbox'"))
        self._save("pages", scans.pages(self.spark, root))
        queue = f"{root}/wiki/_inbox/edges.md"
        if self._exists(queue):
            self._save("proposals", scans.proposals(self.spark, queue))
        self.project()

    def export(self, root: str) -> int:
        """Write all pages as Markdown files under a folder that all executors share; returns how many."""
        return scans.write_files(self.harmonised(), root)

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only versions before the last `keep` used."""
        return self._store.vacuum(keep) + self.search.vacuum(keep)

    # --- capture and ingest ---------------------------------------------------------------------

    @command
    def collect(self, items: DataFrame) -> DataFrame:
        """Add captured items (file_name, channel, source, captured_at, content) to the inbox; (channel, new, duplicates)."""
        none = F.lit(None).cast("string")
        keyed = stash(items.withColumns({"item_key": content_key("content"), "state": F.lit("inbox"), "batch_id": none, "was": none}), "collected")
        raw = self.table("raw")
        new = stash(ingest.named_apart(ingest.unseen(ingest.keep_first(keyed, "item_key", "file_name"), raw), raw), "new")
        new = new.withColumn("path", F.concat(F.lit("raw/inbox/"), "channel", F.lit("/"), "file_name"))
        each = new.groupBy("channel").agg(F.count("*").alias("new"))  # a row a channel
        report = keyed.groupBy("channel").agg(F.count("*").alias("n")).join(each.withColumnRenamed("channel", "_c"), F.col("channel").eqNullSafe(F.col("_c")), "left")
        report = report.select("channel", F.coalesce("new", F.lit(0)).alias("new"), (F.col("n") - F.coalesce("new", F.lit(0))).alias("duplicates"))
        report = self.spark.createDataFrame(report.collect(), "channel string, new long, duplicates long")
        self._append("inbox", new)
        self._log("collect", "collect", report.select("channel", F.lit("collect").alias("op"), F.lit(None).cast("string").alias("path")))
        return report

    def _told(self, items: DataFrame) -> DataFrame:
        """(path, slug, bullet): pages that items name or link to."""
        told = retrieval.mentions(items.select("path", "content"), retrieval.aliases_of(self.live())).withColumnRenamed("id", "slug")
        told = told.unionByName(items.select("path", F.explode(wikilinks("content")).alias("slug"))).distinct()
        said = self._claimed(items).select(F.col("source").alias("path"), F.col("subject").alias("slug"), claims_bullet().alias("bullet"), F.col("recorded_at").cast("date").alias("verified"))
        told = told.join(items.select("path", "file_name"), "path").select("path", "slug", F.concat(F.lit("mentioned in "), "file_name").alias("bullet"), F.lit(None).cast("date").alias("verified"))
        return told.unionByName(said.join(told.select("path", "slug").distinct(), ["path", "slug"], "left_semi").distinct())

    def _claimed(self, items: DataFrame) -> DataFrame:
        """The claims of items, their subjects by the slugs of the pages that have such a name."""
        known = retrieval.aliases_of(self.live()).select(F.col("id"), slugify("alias").alias("subject")).groupBy("subject").agg(F.min("id").alias("id"))
        found = claims.extract(items)
        return found.join(graph.small(known), "subject", "left").withColumn("subject", F.coalesce("id", "subject")).select(found.columns)

    def claims(self) -> DataFrame:
        """All claims that were ingested, with what contradicts and supersedes them."""
        return claims.settle(self.table("claims"))

    def _rebuilt(self, items: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
        """(changes by source, as reviewed; changes by page, as committed), both of one set of mentions."""
        told, pages = stash(self._told(items), "told"), self.live()
        return tuple(stash(ingest.fan_out(items, told, pages, batch_id, by_source), "planned") for by_source in (True, False))

    def plan(self, batch_id: str) -> DataFrame:
        """The changes that ingesting the inbox would make, as (batch_id, source_path, path, op, before, after)."""
        return self._rebuilt(ingest.split_valid(self.table("inbox"))[0], batch_id)[0]

    @command
    def ingest(self, batch_id: str, approve: bool = False) -> DataFrame:
        """One diff per source of the inbox; with approve, committed: pages, filed items, proposals, log. A second run changes nothing."""
        good, bad = ingest.split_valid(self.table("inbox"))
        by_source, by_page = self._rebuilt(good, batch_id)
        diff = stash(ingest.consolidated(by_source), "diff")
        if approve:
            if self.table("changes").where(F.col("batch_id") == batch_id).limit(1).count():
                raise ValueError(f"there is a batch {batch_id} already")
            proposals = self.table("proposals")
            self._append("proposals", ingest.queue(ingest.propose_edges(good, "file_name", "content"), proposals).withColumn("batch_id", F.lit(batch_id)))
            said = self._claimed(good).join(good.select(F.col("path").alias("source"), dated_path("channel", "captured_at", "file_name").alias("_to")), "source")
            self._append("claims", said.withColumn("source", F.col("_to")).withColumn("batch_id", F.lit(batch_id)))
            self._commit_pages(by_page, batch_id)
            self._log("ingest", batch_id, good.select("channel", F.lit("file").alias("op"), "path"))
            self._append("filed", ingest.file_away(good, batch_id).unionByName(bad))
            self._save("inbox", self.table("inbox").where("false"))
            self.project()
        return diff

    def _pages_of(self, files: DataFrame) -> DataFrame:
        named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).select("path", "file_name", "content")
        return named.mapInArrow(frontmatter.parse_pages, schemas.PAGES)

    def _commit_pages(self, changes: DataFrame, batch_id: str) -> None:
        pages = self.table("pages")
        touched = self._pages_of(changes.where("op <> 'delete'").select("path", F.col("after").alias("content")))
        self._append("changes", changes.select(F.lit(batch_id).alias("batch_id"), "path", "op", "before", "after"))
        self._save("pages", pages.join(changes.select("path"), "path", "left_anti").unionByName(touched))

    @staticmethod
    def _files(pages: DataFrame) -> DataFrame:
        return pages.mapInArrow(frontmatter.render_pages, "path string, content string")

    def undo_plan(self, batch_id: str) -> DataFrame:
        """(path, op, now, after, conflict): what undoing a batch makes of its pages, and what stands against it."""
        changes = self.table("changes")
        own = self.table("pages").join(changes.where(F.col("batch_id") == batch_id).select("path"), "path", "left_semi")
        return ingest.undo_plan(self._files(own), changes, batch_id)

    @command
    def undo_ingest(self, batch_id: str) -> None:
        """Reverse a batch: what it did to pages is taken back, its items return to the inbox, its queued proposals go unless other items make them, its claims too.

        What later batches did to the same pages stays. Refused if `undo_plan` has conflicts; `ingest.dependents` names the batches that have to go first.
        """
        plan = stash(self.undo_plan(batch_id), "undo")
        conflicts = plan.where("conflict is not null").count()
        if conflicts:
            raise ValueError(f"{conflicts} pages of {batch_id} were changed since in ways that can't be kept; see undo_plan")
        pages = self.table("pages")
        back = self._pages_of(plan.where("op <> 'delete'").select("path", F.col("after").alias("content")))
        mine = F.coalesce(F.col("batch_id") == batch_id, F.lit(False))
        filed, none = self.table("filed"), F.lit(None).cast("string")
        again = filed.where(mine).withColumns({"path": F.col("was"), "state": F.lit("inbox"), "batch_id": none, "was": none})
        self._log("undo", batch_id, again.select("channel", F.lit("undo").alias("op"), "path"))
        self._append("inbox", again)
        self._save("filed", filed.where(~mine))
        queued, keys = self.table("proposals"), ["src", "edge", "dst"]
        others = ingest.propose_edges(filed.where(~mine & (F.col("state") == "filed")), "file_name", "content").select(*keys)
        stay = queued.where(mine).join(others, keys, "left_semi").withColumn("batch_id", none)
        self._save("proposals", queued.where(~mine).unionByName(stay))
        self._save("claims", self.table("claims").where(~mine))
        self._save("pages", pages.join(plan.select("path"), "path", "left_anti").unionByName(back))
        self._save("changes", self.table("changes").where(F.col("batch_id") != batch_id))
        self.project()

    @command
    def compile(self, scope: DataFrame, batch_id: str, approve: bool = False) -> DataFrame:
        """Rebuild the mentions of pages from the raw items in `scope` (path); the changes by source, committed with approve."""
        items = maintenance.scoped(self.table("raw"), scope, "path")
        by_source, by_page = self._rebuilt(items, batch_id)
        if approve:
            self._commit_pages(by_page, batch_id)
            self._log("compile", batch_id, by_page.select(F.lit(None).cast("string").alias("channel"), "op", "path"))
            self.project()
        return by_source

    @command
    def _approve(self, skill: str, changes: DataFrame, batch_id: str, approve: bool) -> DataFrame:
        """The changes written down, so that what is reviewed is what is committed; with approve they are."""
        changes = stash(changes, "planned")
        if approve:
            self._commit_pages(changes, batch_id)
            self._log(skill, batch_id, changes.select(F.lit(None).cast("string").alias("channel"), "op", "path"))
            self.project()
        return changes

    @command
    def archive_log(self, before: str) -> None:
        """Move the log's entries before a time to the archive."""
        log, old = self.table("log"), F.col("ts") < F.lit(before).cast("timestamp")
        self._append("log_archive", log.where(old))
        self._save("log", log.where(~old))

    # --- graph ----------------------------------------------------------------------------------

    @command
    def project(self) -> None:
        """Rebuild nodes and edges, a pure function of the pages."""
        nodes, edges = graph.project(self.live())
        self._save("nodes", nodes)
        self._save("edges", edges)

    def validate(self) -> DataFrame:
        return graph.validate(self.table("nodes"), self.table("edges"), schemas.vocab_nodes(self.spark), schemas.vocab_edges(self.spark))

    @command
    def promote(self, decisions: DataFrame, approve: bool = True, batch_id: str | None = None) -> DataFrame:
        """Confirmed proposals into the pages' frontmatter, then the graph again; skipped ones leave the queue too.

        Edges with a list of their own join it, superseded_by is replaced, others are lists among the other keys. A
        confirmed edge of a page that there isn't stays in the queue. Returns the changes, which are committed unless approve is false.
        """
        queued, keys, pages = self.table("proposals"), ["src", "edge", "dst"], self.table("pages")
        confirmed = queued.join(decisions.where("decision = 'confirm'").select(*keys), keys, "left_semi").join(pages.select(F.col("slug").alias("src")), "src", "left_semi").select(*keys)
        confirmed = stash(confirmed.distinct(), "confirmed")
        for key in frontmatter.LISTS:
            pages = graph.into_frontmatter(pages, confirmed, key)
        pages = graph.into_column(pages, confirmed, "superseded_by")
        pages = graph.into_rest(pages, confirmed.where(~F.col("edge").isin(*frontmatter.LISTS, "superseded_by")))
        skipped = decisions.where("decision <> 'confirm'").select(*keys)
        return self._revised("promote", batch_id, approve, pages, proposals=queued.join(confirmed.unionByName(skipped), keys, "left_anti"))

    def neighbours(self, slug: str, hops: int = 1, edge_names: list[str] | None = None) -> DataFrame:
        return graph.hops(self.spark.createDataFrame([(slug,)], "id string"), self.table("edges"), hops, edge_names)

    def match(self, pattern: str) -> DataFrame:
        """Paths by a pattern, (person)-[works_at]->(org) for instance."""
        return graph.match(pattern, self.table("nodes"), self.table("edges"))

    def canvas(self) -> DataFrame:
        return graph.canvas(self.table("nodes"), self.table("edges"))

    # --- asking and health ----------------------------------------------------------------------

    def reindex(self, excluded: list[str] = ()) -> tuple[int, int, int]:
        """Bring the search index to the pages whose path no pattern excludes; (pages added or changed, removed or replaced, postings written)."""
        return self.search.update(retrieval.searched(scans.excluded(self.live(), list(excluded))).withColumnRenamed("slug", "id"))

    def query(self, question: str, k: int = 10, excluded: list[str] = ()) -> DataFrame:
        """Cited passages by keywords, vectors and the graph. What changed since the index was last brought up to date is indexed first."""
        self.reindex(excluded)
        pages = self.live()
        items = self.table("raw").select("path", "content").unionByName(pages.select("path", F.col("body").alias("content")))
        found = lambda terms, n: self.search.top(terms, n).rows
        return retrieval.query(question, pages, self.table("edges"), items, k, vectors=self.search.vectors(), found=found)

    def thread(self, topic: str) -> DataFrame:
        raw = self.table("raw").select("path", F.col("content").alias("text"), F.col("captured_at").alias("at"))
        wiki = self.live().where("not path like 'wiki/threads/%'").select("path", F.col("body").alias("text"), F.coalesce("last_verified", "created").cast("timestamp").alias("at"))
        return maintenance.thread(raw, wiki, topic)

    @command
    def write_thread(self, topic: str, batch_id: str, approve: bool = False) -> DataFrame:
        """The topic's thread page as a change, committed with approve."""
        page = maintenance.thread_page(self.thread(topic), topic)
        old = self._files(self.table("pages").join(page.select("path"), "path", "left_semi"))
        new = self._files(self._pages_of(page))
        return self._approve("thread", ingest.changes_between(old, new, batch_id), batch_id, approve)

    def maps(self) -> DataFrame:
        return maintenance.maps(self.live())

    def lint(self, as_of: str, days: int = 90) -> DataFrame:
        """The pages' findings, and claims that contradict each other."""
        open_ = lint.contradictions(self.claims()).select(F.lit("unresolved_contradiction").alias("rule"), F.col("a").alias("slug"), F.col("b").alias("detail"))
        return lint.lint(self.live(), as_of, days).unionByName(open_)

    def status(self, as_of: str) -> dict[str, DataFrame]:
        return {
            "inbox": status.inbox_depth(self.table("raw").where("state = 'inbox'")),
            "pages": status.page_counts(self.live()),
            "debt": lint.debt(self.lint(as_of)),
            "last_ingest": status.last_ingest(self.table("log").where("skill = 'ingest'")),
            "log": status.log_size(self.table("log")),
        }

    def overview(self, as_of: str) -> str:
        return status.overview(status.page_counts(self.live()), lint.debt(self.lint(as_of)))

    # --- upkeep ---------------------------------------------------------------------------------

    def link(self, distance: int = 2) -> DataFrame:
        """(stub, slug, distance): canonical pages that tofile stubs may be."""
        pages = self.live()
        return maintenance.link_candidates(pages.where("type = 'tofile'"), pages.where("type <> 'tofile'"), distance)

    def _revised(self, skill: str, batch_id: str | None, approve: bool, pages: DataFrame, **others: DataFrame) -> DataFrame:
        """The changes (batch_id, path, op, before, after) from the pages to `pages`; with approve, these and other tables are saved, written down and logged."""
        batch_id = batch_id or f"{skill}-{self._began[0] + 1}"
        pages = stash(pages, "revised")
        changes = stash(ingest.changes_between(self._files(self.table("pages")), self._files(pages), batch_id), "planned")
        if approve:
            self._save("pages", pages)
            for name, df in others.items():
                self._save(name, df)
            self._append("changes", changes)
            self._log(skill, batch_id, changes.select(F.lit(None).cast("string").alias("channel"), "op", "path"))
            self.project()
        return changes

    def _repointed(self, names: DataFrame) -> dict[str, DataFrame]:
        """Proposals and redirects with slugs renamed by (old, new), and redirects from the old ones."""
        redirects = maintenance.rename(self.table("redirects"), names, "to_slug").where("from_slug <> to_slug")
        new = names.select(F.col("old").alias("from_slug"), F.col("new").alias("to_slug"))
        redirects = redirects.join(new.select("from_slug"), "from_slug", "left_anti").unionByName(new)
        return {"proposals": maintenance.rename(self.table("proposals"), names, "src", "dst"), "redirects": redirects}

    def same(self, least: float = 0.9) -> DataFrame:
        """(slug, identity_key, n): pages of one type that are probably one thing under several names, by their names, works_at and key, for review and `merge`."""
        pages = self.live().where("type is not null")
        rows = pages.select("slug", F.regexp_replace("slug", "-", " ").alias("name"), "type", F.array_join(F.array_sort("works_at"), " ").alias("works_at"), "identity_key")
        found = resolution.resolve(rows, "slug", "name", ("type", "works_at", "identity_key"), least)
        typed = found.withColumnRenamed("id", "slug").join(pages.select("slug", "type"), "slug")
        several = typed.groupBy("entity", "type").agg(F.count("*").alias("n")).where("n > 1")
        return typed.drop("n").join(several, ["entity", "type"]).select("slug", F.concat_ws("/", "type", "entity").alias("identity_key"), "n")

    @command
    def merge(self, approve: bool = True, batch_id: str | None = None, identities: DataFrame | None = None) -> DataFrame:
        """Fold pages with one identity key into the smallest slug, lists and bodies; the others become redirects, and what named them names the keeper.

        The key is the pages' own, or that of `identities` (slug, identity_key), such as `same` gives. Returns (identity_key, keeper, n), or without approval the changes, of which nothing is then written.
        """
        pages, lists = self.live(), ("aliases", "sources", "works_at", "contradicts")
        if identities is not None:
            pages = pages.drop("identity_key").join(identities.select("slug", "identity_key"), "slug")
        filled = pages.select("identity_key", "slug", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists))
        folded = maintenance.merge(filled, "identity_key", "slug", *lists).where("n > 1")
        texts = F.array_sort(F.collect_list(F.struct("slug", F.trim(F.coalesce("body", F.lit(""))).alias("body"))))
        bodies = pages.groupBy("identity_key").agg(F.array_join(F.filter(F.array_distinct(F.transform(texts, lambda x: x["body"])), lambda b: b != ""), "\n\n").alias("body"))
        folded = stash(folded.join(bodies, "identity_key"), "folded")
        gone = pages.join(folded.select("identity_key", "keeper"), "identity_key").where("slug <> keeper").select(F.col("slug").alias("old"), F.col("keeper").alias("new"))
        gone = stash(gone, "gone")
        new = self.table("pages").join(gone.select(F.col("old").alias("slug")), "slug", "left_anti").join(folded.select(F.col("keeper").alias("slug"), F.col("body").alias("_body"), *(F.col(c).alias(f"_{c}") for c in lists)), "slug", "left")
        new = new.withColumn("body", F.coalesce("_body", "body"))
        for c in lists:
            new = new.withColumn(c, F.when(F.size(f"_{c}") > 0, F.col(f"_{c}")).otherwise(F.col(c)))
        changes = self._revised("merge", batch_id, approve, maintenance.redirected(new.select(pages.columns), gone), **self._repointed(gone))
        return folded.select("identity_key", "keeper", "n") if approve else changes

    @command
    def rename(self, old: str, new: str, approve: bool = True, batch_id: str | None = None) -> DataFrame:
        """A slug everywhere: the page, its file, lists, superseded_by, edges among the other keys, links in bodies, proposals and redirects; the old one becomes a redirect.

        Returns the changes, which are committed unless approve is false. A slug that there is already is refused, as is one that there isn't to rename.
        """
        names = self.spark.createDataFrame([(old, new)], "old string, new string")
        pages, mine = self.table("pages"), F.col("slug") == old
        there = {r["slug"] for r in pages.where(F.col("slug").isin(old, new)).select("slug").collect()}
        if new in there or old not in there:
            raise ValueError(f"there is a page {new} already" if new in there else f"there is no page {old}")
        moved = pages.withColumns({
            "path": F.when(mine, F.concat(F.regexp_replace("path", r"[^/]+$", ""), F.lit(f"{new}.md"))).otherwise(F.col("path")),
            "file_name": F.when(mine, F.lit(f"{new}.md")).otherwise(F.col("file_name")),
            "slug": F.when(mine, F.lit(new)).otherwise(F.col("slug")),
        })
        return self._revised("rename", batch_id, approve, maintenance.redirected(moved, names), **self._repointed(names))

    @command
    def refactor(self, longest: int, batch_id: str = "refactor", approve: bool = False) -> DataFrame:
        """Split pages longer than `longest` into their sections; the changes, committed with approve."""
        pages = self.table("pages")
        after = maintenance.split_pages(pages, longest)
        before = pages.join(after.select("path"), "path", "left_semi")
        return self._approve("refactor", ingest.changes_between(self._files(before), self._files(after), batch_id), batch_id, approve)

    def harmonised(self) -> DataFrame:
        """(path, content): every page with its frontmatter in the contract's order."""
        return self.table("pages").mapInArrow(frontmatter.render_pages, "path string, content string")

    @command
    def archive(self, as_of: str, days: int = 90, approve: bool = True, batch_id: str | None = None) -> DataFrame:
        """Move stale pages to the archive, leaving redirects; returns these, or without approval the changes.

        What is in the archive is no longer searched, checked or part of the graph; it is still exported.
        """
        pages = self.live()
        moved, redirects = maintenance.archive(pages, lint.stale(pages, as_of, days))
        redirects = stash(redirects, "redirects")
        away = self.table("pages").where(F.col("path").startswith(schemas.ARCHIVE))
        old = self.table("redirects").join(redirects.select("from_slug"), "from_slug", "left_anti")
        changes = self._revised("archive", batch_id, approve, moved.unionByName(away), redirects=old.unionByName(redirects))
        return redirects if approve else changes
