"""The engine's entry points over catalog tables: search, content, paths, facts, standing tasks, settings."""

from __future__ import annotations

import dataclasses
import threading
import uuid
import warnings
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import plugins, schemas
from .jobs import Jobs
from .operators import bounded, catalog, chunk, facts, index, search, words
from .operators.tables import Change, Store, Table
from .sources import files
from .streaming import documents as states

STRATEGIES = ("DIRECT_CONTENT", "NEW_QUESTION", "SIMILAR_QUESTION")
#: Called with an event's name and the (file_path, op) of the documents concerned.
Listener = Callable[[str, DataFrame], None]
BEFORE, AFTER = "before_change", "after_change"

TABLES = {
    "documents": Table("doc_id LONG, file_path STRING, md5 STRING, update_time TIMESTAMP, create_time TIMESTAMP, state STRING", "doc_id"),
    "directories": Table(catalog.ROLLUP, "prefix", merged=catalog.rolled_up),
    "paragraphs": Table("para_id LONG, doc_id LONG, ord INT, content STRING, bucket INT", "doc_id", ("bucket",), order=("doc_id", "ord")),
    "facts": Table("pair STRING, task_id LONG, doc_id LONG, para_id LONG, seq INT, fact STRING", "pair"),
    "tasks": Table(schemas.TASK, "id"),
    #: Buckets of documents whose facts a task has, and the calls that were made for them.
    "progress": Table("step STRING, task_id LONG, bucket INT", "step"),
    "calls": Table("task_id LONG, bucket INT, g INT, batch INT, cost LONG, attempts INT, error STRING, question STRING", "task_id"),
    "roots": Table("directory_path STRING", "directory_path"),
    "settings": Table("config_key STRING, config_value STRING, at LONG", "config_key"),
    "words": Table("word STRING, n DOUBLE", "word"),
    **index.TABLES,
}


class Engine:
    """documents, their paragraphs, an index of paragraphs, standing tasks and their facts, in one store.

    Every call reads one state of the store and makes its changes visible by one commit; a refresh by several.
    """

    #: Paragraphs of a refresh's commit, without and with a model.
    PARAGRAPHS, CALLS = 10_000_000, 2_000

    def __init__(self, spark: SparkSession, location: str, model: plugins.LanguageModel | None = None, analyzer: search.Analyzer = search.STEMMED, listeners: list[Listener] | None = None, buckets: int = index.BUCKETS, registry: plugins.Registry | None = None):
        self.spark = spark
        self.registry = registry or plugins.Registry()
        self.location = location.rstrip("/")
        self.model = model
        self.listeners = list(listeners or [])
        self.jobs = Jobs(spark)
        self._own = threading.local()  # each thread, a background job's too, clears up after itself
        self.store = Store(spark, self.location, TABLES, buckets=buckets)
        if analyzer is search.STEMMED:  # an index by learned words is read by them
            analyzer = search.segmented({r.word: r.n for r in self.store.read("words").limit(words.VOCABULARY).collect()})
        self.index = index.TextIndex(spark, self.location, buckets, self.store, analyzer)
        self._settings = plugins.Expiring(lambda: self.store.read("settings"), 30)

    @property
    def analyzer(self) -> search.Analyzer:
        return self.index.analyzer

    def learn_words(self, **options: float) -> int:
        """Learn the words of scripts without blanks from all paragraphs (words.learn) and index anew by them, in one commit; their number."""
        state = self.store.state()
        para = self.store.read("paragraphs", state)
        known = words.learn(para, "content", **options)
        self.index.use(search.segmented(known))
        rows = self.spark.createDataFrame(list(known.items()), TABLES["words"].schema)
        self.store.commit({"words": Change(rows, everything=True), **self.index.changes(para, None, "para_id", "content", everything=True)}, state)
        return len(known)

    def bucket(self, doc_id: str = "doc_id") -> Column:
        """The bucket of a document: what a refresh works on at a time."""
        return F.pmod(F.xxhash64(doc_id), F.lit(self.index.buckets)).cast("int")

    def documents(self) -> DataFrame:
        return self.store.read("documents")

    def paragraphs(self) -> DataFrame:
        return self.store.read("paragraphs")

    def tasks(self) -> DataFrame:
        return self.store.read("tasks")

    def facts(self) -> DataFrame:
        return self.store.read("facts")

    # -- ingestion ----------------------------------------------------------------------------

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """df written once beside the tables, so that its uses agree and its sources are read once."""
        path = f"{self.location}/_work/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._own.__dict__.setdefault("work", []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _clean(self, results: int = 4) -> None:
        """Delete what was written beside the tables, but for the last few lists of changes, which callers may still read."""
        work = self._own.__dict__.get("work", [])
        told = [p for p in work if p.rpartition("/")[2].startswith(("changes-", "deletions-", "ignored-", "result-"))][-results:]
        fs, path = self.store._fs()
        for p in work:
            if p not in told:
                fs.delete(path(p), True)
        self._own.work = told

    def _tell(self, event: str, changes: DataFrame) -> None:
        for listener in self.listeners:
            listener(event, changes)

    def ingest(self, root: str, ignore: list[str] | None = None) -> DataFrame:
        """Bring the documents below a folder up to date, with paragraphs, index and standing tasks; the changes (file_path, op).

        Files are listed with their times; only new and later ones are opened. What is found is written
        once, and one commit makes all of it visible, so a run that fails is simply run again.
        """
        ignore = schemas.IGNORED_BY_DEFAULT if ignore is None else ignore
        state = self.store.state()
        base = root.rstrip("/") + "/"
        listed = files.readable(files.unignored(files.listing(self.spark, root), ignore), self._settings.get()).withColumn("file_path", F.concat(F.lit(base), "path"))
        old = self.store.read("documents", state).filter(catalog.under(F.col("file_path"), base))
        known = old.select("file_path", "doc_id", F.col("md5").alias("old_md5"), "update_time", F.col("create_time").alias("old_create"), F.col("state").alias("old_state"))
        later = F.col("doc_id").isNull() | (F.col("modified") > F.col("update_time")) | (F.col("old_state") == schemas.SAVED)
        due = self._written(listed.join(known, "file_path", "left").filter(later).select(*listed.columns, "doc_id", "old_md5", "old_create", "old_state"), "due")
        parsed = files.parsed(files.contents(self.spark, root, due))
        same = F.col("md5").eqNullSafe(F.col("old_md5")) & (F.col("old_state") != schemas.SAVED)
        op = F.when(F.col("doc_id").isNull(), "create").when(same, "touch").otherwise("modify")
        found = due.drop("extension", "fmt", "length").join(parsed.select("path", "md5", "markdown", "error"), "path").withColumn("op", op)
        found = found.withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("file_path")))
        lost = old.filter(F.col("state") != schemas.IGNORED).join(listed.select("file_path"), "file_path", "left_anti").select("file_path", "doc_id", F.lit("delete").alias("op"))
        found = self._written(found.unionByName(lost, allowMissingColumns=True), "changes")
        return self._apply(state, found)

    def sync(self, roots: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
        """ingest() of several folders, of the registered ones unless given; one row: total, success and the sorted failed ones. A folder that fails doesn't keep the others from being read."""
        done = []
        for root in [r.directory_path for r in self.directories().orderBy("directory_path").toLocalIterator()] if roots is None else roots:
            try:
                self.ingest(root, ignore)
                done.append((root, True))
            except Exception as e:  # told in the result; the folder is read again at the next sync
                warnings.warn(f"{root}: {type(e).__name__} {e}"[:500], stacklevel=2)
                done.append((root, False))
        return catalog.sync_summary(self.spark.createDataFrame(done, "directory_path string, ok boolean"))

    def _apply(self, state: tuple[int, dict], found: DataFrame) -> DataFrame:
        """One commit for found changes: file_path, doc_id, op, modified, md5, old_md5, old_create, markdown, error."""
        changes = found.select("file_path", "op")
        if found.isEmpty():
            return changes
        self._tell(BEFORE, changes)
        read = lambda name: self.store.read(name, state)
        fresh = found.filter("op IN ('create', 'modify')")
        status = F.when(F.col("error").isNull(), schemas.INDEXED).otherwise(schemas.ERROR)
        documents = fresh.select("doc_id", "file_path", "md5", F.col("modified").alias("update_time"), F.coalesce("old_create", "modified").alias("create_time"), status.alias("state"))
        touched = read("documents").join(found.filter("op = 'touch'").select("doc_id", "modified"), "doc_id").withColumn("update_time", F.col("modified")).drop("modified")
        moved = found.filter("op <> 'create'").select("doc_id")
        gone = found.filter("op IN ('modify', 'delete')").select("doc_id")
        cut = chunk.chunks(fresh.select("doc_id", F.col("markdown").alias("text")))
        para = self._written(cut.select(F.xxhash64("doc_id", "ord").alias("para_id"), "doc_id", "ord", "content", self.bucket().alias("bucket")), "paragraphs")
        old_para = read("paragraphs").join(gone, "doc_id", "left_semi").select(F.col("para_id").alias("doc_id"))
        own, tasks, calls = self._maintained(state, found, para)
        now = documents.unionByName(touched.select(documents.columns))
        self.store.commit(
            {
                "documents": Change(now, moved),
                "directories": Change(catalog.rollup_change(read("documents").join(moved, "doc_id", "left_semi"), now)),
                "paragraphs": Change(para, gone),
                **self.index.changes(para, old_para, "para_id", "content"),
                "facts": Change(own, read("facts").join(gone, "doc_id", "left_semi").select("pair")),
                "tasks": Change(tasks, tasks.select("id")),
                **({"calls": Change(calls)} if calls is not None else {}),
            },
            state,
        )
        self._clean()
        self._tell(AFTER, changes)
        return changes

    def _maintained(self, state: tuple[int, dict], found: DataFrame, para: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(facts of the changed documents, the tasks whose counters change, calls): the affected (task, document) pairs only.

        A task that is still to be refreshed is affected in the buckets that it has done.
        """
        tasks = self.store.read("tasks", state)
        pairs = facts.affected(found.filter("op <> 'touch'").select("doc_id", "file_path", "op"), tasks).join(found.select("doc_id", "op"), "doc_id")
        done = self.store.read("progress", state).select("task_id", "bucket")
        pairs = self._written(pairs.withColumn("bucket", self.bucket()).join(done, ["task_id", "bucket"], "left_semi"), "pairs")
        asked = pairs.filter("op <> 'delete'").join(bounded.broadcast(tasks.select(F.col("id").alias("task_id"), "key_question")), "task_id")
        rows = para.drop("bucket").join(asked.select("task_id", "doc_id", "key_question", "bucket"), "doc_id")
        fresh, cost, calls = self._extracted(rows)
        delta = pairs.groupBy("task_id").agg(F.sum(F.when(F.col("op") == "create", 1).when(F.col("op") == "delete", -1).otherwise(0)).cast("int").alias("more"))
        out = tasks.join(delta.withColumnRenamed("task_id", "id"), "id").join(cost.withColumnRenamed("task_id", "id"), "id", "left")
        out = out.withColumns({
            "covered_file_count": F.greatest(F.coalesce("covered_file_count", F.lit(0)) + F.col("more"), F.lit(0)),
            "incremental_cost": F.coalesce("incremental_cost", F.lit(0).cast("long")) + F.coalesce("cost", F.lit(0).cast("long")),
        })
        return fresh, self._written(out.select(tasks.columns), "tasks"), calls

    def _extracted(self, rows: DataFrame, cap: int = 0) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(facts, cost by task, calls) of rows (task_id, bucket, doc_id, para_id, content, key_question).

        With a model, paragraphs go to it one by one (cap 0) or in batches of `cap` characters; each call is a row, one that failed too.
        """
        columns = [F.concat_ws(":", "task_id", "doc_id").alias("pair"), "task_id", "doc_id", "para_id", "seq", "fact"]
        if self.model is None:
            fresh = self._written(facts.extract(rows, F.col("key_question")).select(columns), "facts")
            return fresh, facts.cost_of(rows, fresh), None
        rows = self._written(rows, "asked")
        answers = facts.extract_with(plugins.extractor_of(self.model), facts.batched(rows, ["task_id", "bucket", "key_question"], cap).repartition("task_id", "bucket", "g", "batch"))
        answers = self._written(answers.withColumnRenamed("key_question", "question"), "answers")
        place = Window.partitionBy("task_id", "para_id").orderBy("g", "batch", "seq")
        found = facts.parsed(answers).withColumn("seq", F.row_number().over(place) - 1)
        # a model may name a paragraph that it wasn't given
        fresh = self._written(found.join(rows.select("task_id", "para_id", "doc_id"), ["task_id", "para_id"]).select(columns), "facts")
        return fresh, answers.groupBy("task_id").agg(F.sum("cost").alias("cost")), answers.drop("response")

    def put(self, rows: DataFrame) -> DataFrame:
        """Bring documents given as (file_path, markdown, modified) up to date, like the files of ingest(); the changes (file_path, op)."""
        state = self.store.state()
        known = self.store.read("documents", state).select("file_path", "doc_id", F.col("md5").alias("old_md5"), "update_time", F.col("create_time").alias("old_create"))
        new = rows.select("file_path", "markdown", "modified", F.md5(F.coalesce("markdown", F.lit(""))).alias("md5")).join(known, "file_path", "left")
        op = F.when(F.col("doc_id").isNull(), "create").when(F.col("modified") > F.col("update_time"), F.when(F.col("md5").eqNullSafe(F.col("old_md5")), "touch").otherwise("modify"))
        found = new.withColumn("op", op).filter("op IS NOT NULL").withColumns({"doc_id": F.coalesce("doc_id", F.xxhash64("file_path")), "error": F.lit(None).cast("string")})
        return self._apply(state, self._written(found, "changes"))

    def follow(self, events: DataFrame, handler: states.Handler = states.parsing, attempts: int = 3, delay: float = 1.0, period: str = "5 seconds", checkpoint: str | None = None) -> StreamingQuery:
        """Keep the documents up to date by a stream of events (states.EVENT): each is parsed, tried again if that fails, and committed with its batch.

        A document that can't be read becomes ERROR. A batch that is replayed finds its documents as they are. One query at a time writes to the store.
        """
        if self.spark.conf.get("spark.sql.streaming.stateStore.providerClass") != states.PROVIDER:
            raise ValueError(f"retries are kept by timers: set spark.sql.streaming.stateStore.providerClass to {states.PROVIDER}")
        told = states.outcomes(events, handler, attempts, delay)
        writer = told.writeStream.foreachBatch(lambda batch, _: self._followed(batch)).option("checkpointLocation", checkpoint or f"{self.location}/_follow")
        return writer.trigger(processingTime=period).start()

    def _followed(self, batch: DataFrame) -> None:
        last = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("modified"), F.desc("attempt")))
        final = batch.filter(F.col("state") != schemas.SAVED).withColumn("k", last).filter("k = 1")  # one to be tried again changes nothing yet
        final = self._written(final, "outcomes")
        if final.isEmpty():
            self._clean()
            return
        state = self.store.state()
        known = self.store.read("documents", state).select("file_path", F.col("doc_id").alias("old_id"), F.col("md5").alias("old_md5"), "update_time", F.col("create_time").alias("old_create"), F.col("state").alias("old_state"))
        found = final.withColumn("md5", F.md5(F.coalesce("markdown", F.lit("")))).join(known, "file_path", "left")
        gone = F.col("state") == schemas.DELETED
        same = F.col("md5").eqNullSafe(F.col("old_md5")) & (F.col("state") == F.col("old_state"))
        op = (
            F.when(gone, F.when(F.col("old_id").isNotNull(), "delete"))
            .when(F.col("old_id").isNull(), "create")
            .when(F.col("modified") > F.col("update_time"), F.when(same, "touch").otherwise("modify"))
            .when((F.col("modified") == F.col("update_time")) & ~same, "modify")
        )
        found = found.withColumns({"op": op, "doc_id": F.coalesce("old_id", F.xxhash64("file_path"))}).filter("op IS NOT NULL")
        self._apply(state, self._written(found.select("file_path", "doc_id", "op", "modified", "md5", "old_md5", "old_create", "markdown", "error"), "changes"))

    def reapply_ignore(self, patterns: list[str], root: str = "") -> DataFrame:
        """After a change of ignore rules: matching documents leave paragraphs, index and facts; others wait for the next ingest; the moved (file_path, op)."""
        state = self.store.state()
        base = root.rstrip("/") + "/" if root else ""
        before = self.store.read("documents", state).filter(catalog.under(F.col("file_path"), base))
        short = before.withColumn("file_path", F.substring("file_path", len(base) + 1, 1 << 20))
        after = catalog.reignore(short, patterns).withColumn("file_path", F.concat(F.lit(base), "file_path"))
        moved = after.join(before.select("doc_id", F.col("state").alias("was")), "doc_id").filter("state <> was").drop("was")
        moved = self._written(moved.select(before.columns), "ignored")
        changes = moved.select("file_path", F.when(F.col("state") == schemas.IGNORED, "ignore").otherwise("restore").alias("op"))
        if moved.isEmpty():
            return changes
        self._tell(BEFORE, changes)
        gone = moved.filter(F.col("state") == schemas.IGNORED).select("doc_id")
        counts = catalog.rollup_change(self.store.read("documents", state).join(moved.select("doc_id"), "doc_id", "left_semi"), moved)
        self.store.commit({"documents": Change(moved, moved.select("doc_id")), "directories": Change(counts), **self._without(state, gone)}, state)
        self._clean()
        self._tell(AFTER, changes)
        return changes

    def _without(self, state: tuple[int, dict], gone: DataFrame) -> dict[str, Change]:
        """What goes with documents (doc_id): paragraphs, postings, facts."""
        read = lambda name: self.store.read(name, state)
        para = read("paragraphs").join(gone, "doc_id", "left_semi").select(F.col("para_id").alias("doc_id"))
        return {"paragraphs": Change(None, gone), **self.index.changes(None, para), "facts": Change(None, read("facts").join(gone, "doc_id", "left_semi").select("pair"))}

    def upload(self, root: str, name: str, content: bytes) -> str:
        """Put a file into a folder, which from now on is one of directories(); its path. A name that is taken is refused."""
        path = files.put(self.spark, root, name, content)
        self.add_directory(root)
        return path

    def directories(self) -> DataFrame:
        """(directory_path) of the folders that sync() reads unless told otherwise."""
        return self.store.read("roots").select("directory_path")

    def add_directory(self, root: str) -> None:
        """Register a folder, once."""
        state = self.store.state()
        new = self.spark.createDataFrame([(root.rstrip("/"),)], "directory_path string")
        if not new.join(self.store.read("roots", state), "directory_path", "left_anti").isEmpty():
            self.store.commit({"roots": Change(new)}, state)

    # -- search -------------------------------------------------------------------------------

    def _live(self) -> DataFrame:
        """(doc_id, file_path, create_time) of searchable documents."""
        return self.documents().filter(F.col("state") == schemas.INDEXED).select("doc_id", "file_path", "create_time")

    def _corpus(self) -> DataFrame:
        return self.paragraphs().join(self._live(), "doc_id").withColumnRenamed("content", "text")

    def _placed(self, hits: DataFrame, query: search.SearchQuery) -> DataFrame:
        """Index hits (doc_id being a paragraph's, score) as (para_id, score, file_path, create_time) within the query's prefix and days."""
        of = self.paragraphs().select("para_id", "doc_id").join(self._live(), "doc_id").select("para_id", "file_path", "create_time")
        return search.restricted(hits.withColumnRenamed("doc_id", "para_id").join(of, "para_id"), query)

    def search(self, query: search.SearchQuery | str) -> DataFrame:
        """rank, para_id, score, title, snippet, url; filled up to top_n by the plain query of the question where the strategy finds fewer."""
        q = search.rewrite(query, self.analyzer) if isinstance(query, str) else query
        first = self._placed(self.index.strategy(q), q)
        by_time = q.last_n_days > 0
        best = search.top(first, q.top_n, "para_id", by_time).withColumn("part", F.lit(0)).drop("rank")
        terms = q.terms(self.analyzer)
        if q.original and best.count() < q.top_n:
            second = self._placed(self.index.fallback(q.original), q)
            best = search.top_up(first, second, q.top_n, "para_id").join(second.select("para_id", "file_path", "create_time").union(first.select("para_id", "file_path", "create_time")).distinct(), "para_id")
        hits = self.paragraphs().select("para_id", F.col("content").alias("text")).join(F.broadcast(best), "para_id")  # top_n rows
        order = [F.desc("create_time"), F.col("para_id")] if by_time else [F.col("part"), F.desc("score"), F.col("para_id")]
        marked = list(dict.fromkeys([*terms, *search.analyze(q.original)]))
        shown = search.snippets(hits, marked) if marked else hits.withColumn("snippet", F.lit(""))
        name = F.regexp_extract("file_path", r"([^/]*)$", 1)
        return shown.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "para_id", "score", name.alias("title"), "snippet", F.col("file_path").alias("url"))

    def simple_search(self, question: str, prefix: str = "", top_n: int = 30) -> DataFrame:
        """Content search with a prefix, ranked; matches in <em>, else the first 150 characters."""
        hits = self._placed(self.index.bm25(self.analyzer.query(question)), search.SearchQuery(path_prefix=prefix))
        best = search.top(hits, top_n, "para_id")
        rows = self.paragraphs().select("para_id", F.col("content").alias("text")).join(F.broadcast(best), "para_id")  # top_n rows
        shown = search.snippets(rows, search.analyze(question), tag="em", missing="")
        return shown.select("rank", "para_id", "score", F.when(F.col("snippet") == "", F.substring("text", 1, 150)).otherwise(F.col("snippet")).alias("snippet"), "file_path")

    def fetch_content(self, ids: list[int]) -> DataFrame:
        """Paragraphs in the order of ids; unknown ids are empty."""
        asked = self.spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "pos int, para_id long")
        got = asked.join(self.paragraphs().select("para_id", "ord", "content"), "para_id", "left")
        return got.select("pos", "para_id", F.coalesce("ord", F.lit(0)).alias("ord"), F.coalesce("content", F.lit("")).alias("content")).orderBy("pos")

    def paths(self, cap: int = 5000) -> DataFrame:
        return catalog.picked(catalog.kept_levels(self.store.read("directories")), cap)

    def path_levels(self) -> DataFrame:
        """(level, prefixes): how many distinct prefixes a level has, from the kept counts."""
        return catalog.kept_levels(self.store.read("directories")).groupBy("level").agg(F.count(F.lit(1)).alias("prefixes"))

    def suggest_paths(self, keyword: str) -> DataFrame:
        return catalog.suggest_paths(self.documents().select("doc_id", F.col("file_path").alias("path")).withColumnRenamed("doc_id", "seq"), keyword)

    def search_all(self, questions: list[str], path: str = "", total: int = 30) -> DataFrame:
        """Hits of several queries like search(): a title once, an equal share of `total` to each query."""
        found = []
        for q, question in enumerate(questions):
            query = plugins.rewrite_with(self.model, question, self.analyzer) if self.model and not q else search.rewrite(question, self.analyzer)
            hits = self.search(dataclasses.replace(query, path_prefix=path, top_n=total))
            found.append(hits.select(F.lit(q).alias("q"), F.col("rank").alias("pos"), "para_id", "score", "title", "snippet", "url"))
        if len(found) == 1:
            return found[0].select(F.col("pos").alias("rank"), "para_id", "score", "title", "snippet", "url")
        kept = search.quota(catalog.union_all(found), len(found), total)  # at most `total` rows
        once = F.row_number().over(Window.partitionBy("para_id").orderBy("q", "pos"))
        kept = kept.withColumn("k", once).filter("k = 1")
        return kept.select(F.row_number().over(Window.orderBy("q", "pos")).alias("rank"), "para_id", "score", "title", "snippet", "url")

    def answer(self, question: str, mode: str = "quickSearch", path: str = "", budget: int = chunk.BATCH) -> DataFrame:
        """search: hits; quickSearch: one row, the prompt of the reranked best and its sources; deepSearch: facts by paragraph with their url.

        The handler that is registered for the path answers; without one, this engine's index does. With a model, the question is
        asked in several ways and the hits share the places.
        """
        handler = self.registry.of(path)
        if mode == "deepSearch":
            return handler.collect_facts(question, path) if handler else self.collect_facts(question, path, budget)[1]
        if handler:
            hits = handler.search(handler.rewrite(question))
        else:
            hits = self.search_all(plugins.queries_with(self.model, question) if self.model else [question], path)
        if mode == "search":
            return hits
        if handler:
            ranked = handler.content(handler.rerank(hits, question))
        else:
            full = hits.join(self.paragraphs().select("para_id", "content"), "para_id")
            order = plugins.rerank_with(self.model, full, question, "para_id") if self.model else plugins.overlap_rerank(full, question, "para_id")
            ranked = search.rerank(full.drop("rank"), order, "para_id").withColumnRenamed("pos", "rank")
        first = ranked.orderBy("rank").limit(chunk.DOCUMENTS)
        sources = facts.result_list(first.select(F.col("rank").alias("seq"), F.col("title").alias("fact"), "url")).select(F.col("results").alias("sources"), "urls")
        return chunk.prompt(ranked.select("rank", "title", "content"), budget).join(F.broadcast(sources))  # one row each

    # -- facts --------------------------------------------------------------------------------

    def collect_facts(self, question: str, path: str = "", budget: int = chunk.BATCH) -> tuple[str, DataFrame]:
        """(strategy, facts by paragraph): stored facts of a like task, else extracted from all paragraphs below path."""
        if path and not path.endswith("/"):
            hit = catalog.wildcard(F.col("file_path"), path) if "*" in path else F.col("file_path") == path
            rows = self._corpus().filter(hit).select("doc_id", "para_id", F.col("text").alias("content"))
            return STRATEGIES[0], self._sourced(facts.by_paragraph(self._asked(rows, question, budget)))
        state = self.store.state()
        above = catalog.tasks_above(self.store.read("tasks", state).filter(F.col("status") == facts.ACTIVE), path)
        asked = above.select("id", F.col("key_question").alias("question"))
        like = plugins.similar_with(self.model, asked, question) if self.model else search.similar_questions(asked, question)
        if not like.isEmpty():
            order = like.select(F.col("id").alias("task_id"), (F.row_number().over(Window.orderBy(F.desc("similarity"), "id")) - 1).alias("pos"))
            used = facts.hits_by_task(order.select("task_id"), above).select(above.columns)
            self.store.commit({"tasks": Change(self._written(used.join(order, F.col("id") == F.col("task_id"), "left_semi"), "hits"), order.select(F.col("task_id").alias("id")))}, state)
            self._clean()
            stored = self.facts().select("task_id", "para_id", "fact")
            return STRATEGIES[2], facts.of_similar(stored, self.paragraphs(), self.documents(), order, path).select("para_id", F.col("fact").alias("facts"), F.col("file_path").alias("url"))
        rows = self._corpus().filter(catalog.under(F.col("file_path"), path)).select("doc_id", "para_id", F.col("text").alias("content"))
        return STRATEGIES[1], self._sourced(facts.by_paragraph(self._asked(rows, question, budget)))

    def _sourced(self, found: DataFrame) -> DataFrame:
        """Facts by paragraph (para_id, facts) with the url of their document."""
        of = self.paragraphs().select("para_id", "doc_id").join(self.documents().select("doc_id", F.col("file_path").alias("url")), "doc_id")
        return found.join(of.select("para_id", "url"), "para_id").orderBy("para_id")

    def _asked(self, rows: DataFrame, question: str, budget: int) -> DataFrame:
        """(para_id, seq, fact) of paragraphs (doc_id, para_id, content): the offline rule, or a model over batches of `budget` characters.

        A model's facts are refined by it, batch by batch, until they fit the budget. The calls are kept in the table of calls, without a task.
        """
        if self.model is None:
            return facts.extract(rows, F.lit(question))
        rows = rows.withColumns({"task_id": F.lit(0).cast("long"), "bucket": F.lit(0), "key_question": F.lit(question)})
        found, _, calls = self._extracted(rows, budget)

        def refine(batches: DataFrame) -> DataFrame:
            pair = F.struct(F.col("para_id").alias("id"), F.col("fact").alias("content"), "seq")
            grouped = batches.groupBy("g", "batch").agg(F.array_sort(F.collect_list(pair)).alias("rows"))
            answers = self._written(facts.extract_with(plugins.refiner_of(self.model), grouped, question), "refined")
            place = Window.partitionBy("para_id").orderBy("g", "batch", "seq")
            briefer = facts.parsed(answers).withColumn("seq", F.row_number().over(place) - 1).select("para_id", "seq", "fact")
            failed = answers.filter("error IS NOT NULL").select("g", "batch")  # their facts stay as they are
            return briefer.unionByName(batches.join(failed, ["g", "batch"], "left_semi").select("para_id", "seq", "fact"))

        brief = facts.reduce_facts(found.select("para_id", "seq", "fact"), refine, budget, written=lambda df: self._written(df, "result"))
        self.store.commit({"calls": Change(calls.withColumn("task_id", F.lit(None).cast("long")))})
        out = self._written(brief, "result")
        self._clean()
        return out

    def submit_facts(self, question: str, path: str = "") -> str:
        return self.jobs.submit(lambda: [r.asDict() for r in self.collect_facts(question, path)[1].collect()])

    def create_task(self, directory: str, question: str) -> None:
        """A standing task unless there is one for the directory and question."""
        row = [(directory.rstrip("/") + "/", question)]
        new = self.spark.createDataFrame(row, "directory_path string, key_question string").select(
            F.xxhash64("directory_path", "key_question").alias("id"), "directory_path", "key_question", F.lit(0).alias("covered_file_count"), F.lit(0).cast("long").alias("full_cost"),
            F.lit(0).cast("long").alias("incremental_cost"), F.lit(0).alias("hit_count"), F.lit(facts.PENDING).alias("status"), F.lit(None).cast("long").alias("checkpoint"), F.lit(None).cast("string").alias("error"),
        )
        state = self.store.state()
        old = self.store.read("tasks", state)
        absent = new.join(old.select("directory_path", "key_question"), ["directory_path", "key_question"], "left_anti").select(old.columns)
        self.store.commit({"tasks": Change(absent)}, state)

    def has_task(self, directory: str) -> bool:
        return catalog.exists(self.tasks(), F.col("directory_path") == directory.rstrip("/") + "/")

    def refresh_tasks(self, full: bool = False) -> None:
        """Extract what open tasks lack (everything of all tasks if full) and make them active.

        Every few buckets of documents (of PARAGRAPHS paragraphs, or CALLS of them with a model) are a commit with their facts, costs and
        the tasks that have done them, so a run that is cut short goes on with the commit where it stopped. A task of which a call failed becomes FAILED with the error; its other buckets stay done.
        """
        if full:
            state = self.store.state()
            old = self.store.read("tasks", state)
            blank = old.withColumns({"status": F.lit(facts.PENDING), "full_cost": F.lit(0).cast("long"), "checkpoint": F.lit(None).cast("long"), "error": F.lit(None).cast("string")})
            empty = {name: Change(self.spark.createDataFrame([], TABLES[name].schema), everything=True) for name in ("facts", "progress", "calls")}
            self.store.commit({**empty, "tasks": Change(self._written(blank, "tasks"), old.select("id"))}, state)
        open_ = F.col("status").isin(facts.PENDING, facts.PROCESSING, facts.FAILED)
        state = self.store.state()
        todo = {r.bucket for r in self._lacking(state, open_, range(self.index.buckets)).select("bucket").distinct().collect()}
        sizes = {r.bucket: r.n for r in self.store.read("paragraphs", state).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        most = self.PARAGRAPHS if self.model is None else self.CALLS
        step: list[int] = []
        for b in sorted(todo):
            if step and sum(sizes.get(x, 0) for x in [*step, b]) > most:
                self._refresh(step, open_)
                step = []
            step.append(b)
        if step:
            self._refresh(step, open_)
        self._settle(open_)

    def _lacking(self, state: tuple[int, dict], open_: Column, buckets: Iterable[int]) -> DataFrame:
        """(task_id, key_question, bucket, step) of open tasks and those of the buckets that they haven't done."""
        tasks = self.store.read("tasks", state).filter(open_)
        each = tasks.select(F.col("id").alias("task_id"), "key_question", F.explode(F.array(*map(F.lit, buckets))).alias("bucket"))
        return each.withColumn("step", F.concat_ws(":", "task_id", "bucket")).join(self.store.read("progress", state).select("step"), "step", "left_anti")

    def _refresh(self, buckets: list[int], open_: Column) -> None:
        """One commit: the facts of some buckets for the tasks that lack them."""
        state = self.store.state()
        read = lambda name, only=None: self.store.read(name, state, only)
        tasks = read("tasks").filter(open_)
        lack = self._written(self._lacking(state, open_, buckets), "lack")
        live = read("documents").filter(F.col("state") == schemas.INDEXED).select("doc_id", "file_path", self.bucket().alias("bucket")).filter(F.col("bucket").isin(buckets))
        own = catalog.tasks_for_paths(live, tasks).join(live, "file_path").join(bounded.broadcast(lack.drop("step")), ["task_id", "bucket"])
        rows = read("paragraphs", F.col("bucket").isin(buckets)).drop("bucket").join(own, "doc_id")
        fresh, cost, calls = self._extracted(rows)
        told, change = lack.select("step", "task_id", "bucket"), {}
        if calls is not None:
            bad = calls.filter("error IS NOT NULL").select("task_id", "bucket").distinct()
            told = told.join(bad, ["task_id", "bucket"], "left_anti")
            lost = rows.select("task_id", "bucket", "para_id").join(bad, ["task_id", "bucket"], "left_semi")
            fresh = fresh.join(lost.select("task_id", "para_id"), ["task_id", "para_id"], "left_anti")  # asked again as a whole
            change["calls"] = Change(calls)
        spent = tasks.join(cost.withColumnRenamed("task_id", "id"), "id").withColumns({
            "full_cost": F.coalesce("full_cost", F.lit(0).cast("long")) + F.coalesce("cost", F.lit(0).cast("long")), "status": F.lit(facts.PROCESSING),
        })
        spent = self._written(spent.select(tasks.columns), "tasks")
        self.store.commit({"facts": Change(fresh), "progress": Change(self._written(told, "progress")), "tasks": Change(spent, spent.select("id")), **change}, state)
        self._clean()

    def _settle(self, open_: Column) -> None:
        """Open tasks that have done all buckets become active, others failed; checkpoint is the number of buckets done."""
        state = self.store.state()
        read = lambda name: self.store.read(name, state)
        tasks = read("tasks").filter(open_)
        live = read("documents").filter(F.col("state") == schemas.INDEXED).select("doc_id", "file_path")
        cover = catalog.tasks_for_paths(live, tasks).join(live, "file_path").groupBy(F.col("task_id").alias("id")).agg(F.countDistinct("doc_id").cast("int").alias("n"))
        done = read("progress").groupBy(F.col("task_id").alias("id")).agg(F.count(F.lit(1)).alias("reached"))
        last = read("calls").filter("error IS NOT NULL").groupBy(F.col("task_id").alias("id")).agg(F.max("error").alias("why"))
        outcome = tasks.join(done, "id", "left").join(last, "id", "left").withColumn("reached", F.coalesce("reached", F.lit(0).cast("long")))
        outcome = outcome.withColumn("error", F.when(F.col("reached") < self.index.buckets, F.coalesce("why", F.lit("not all documents were read"))))
        settled = facts.settle(tasks, outcome.select("id", "error")).drop("error", "checkpoint", "covered_file_count")
        settled = settled.join(outcome.select("id", "error", F.col("reached").alias("checkpoint")), "id").join(cover.withColumnRenamed("n", "covered_file_count"), "id", "left").fillna(0, ["covered_file_count"])
        settled = self._written(settled.select(tasks.columns), "tasks")
        self.store.commit({"tasks": Change(settled, settled.select("id"))}, state)
        self._clean()

    def delete_task(self, task_id: int) -> None:
        state = self.store.state()
        read = lambda name: self.store.read(name, state)
        of = lambda name, key: Change(None, read(name).filter(F.col("task_id") == task_id).select(key))
        self.store.commit({"facts": of("facts", "pair"), "progress": of("progress", "step"), "calls": of("calls", "task_id"), "tasks": Change(None, read("tasks").filter(F.col("id") == task_id).select("id"))}, state)

    def progress(self) -> DataFrame:
        """Standing tasks with their documents, facts and status."""
        held = self.facts().groupBy(F.col("task_id").alias("id")).agg(F.count(F.lit(1)).alias("facts"))
        return self.tasks().join(held, "id", "left").fillna(0, ["facts"]).select("id", "directory_path", "key_question", "status", "covered_file_count", "facts", "full_cost", "incremental_cost", "hit_count", "error")

    # -- settings and directories -------------------------------------------------------------

    def set(self, key: str, value: str) -> None:
        state = self.store.state()
        at = (self.store.read("settings", state).agg(F.max("at")).first()[0] or 0) + 1
        new = self.spark.createDataFrame([(key, value, at)], TABLES["settings"].schema)
        self.store.commit({"settings": Change(new, new.select("config_key"))}, state)
        self._settings.forget()

    def get(self, key: str, kind: str, default: object) -> object:
        return files.setting(self._settings.get(), key, kind, default).first().value

    def settings(self) -> DataFrame:
        return self.store.read("settings").select("config_key", "config_value").orderBy("config_key")

    def delete(self, condition: Column) -> None:
        """Documents that meet the condition go, with their paragraphs, postings and facts; tasks above them cover fewer."""
        state = self.store.state()
        lost = self.store.read("documents", state).filter(condition).select("file_path", "doc_id", F.lit("delete").alias("op"))
        kind = "modified timestamp, md5 string, old_create timestamp, markdown string, error string"
        empty = self.spark.createDataFrame([], f"file_path string, doc_id long, op string, {kind}")
        self._apply(state, self._written(empty.unionByName(lost, allowMissingColumns=True), "deletions"))

    def directory_status(self, directories: list[str]) -> DataFrame:
        """Documents, indexed, failed and the completion rate of directories, from the counts kept at each commit."""
        asked = [d.rstrip("/") + "/" for d in directories]
        rows = self.spark.createDataFrame([(d,) for d in asked], "directory_path string")
        return catalog.kept_status(rows, self.store.read("directories", only=F.col("prefix").isin(asked)))
