"""One object with a method for each question a user of the corpus asks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import catalog, listing, reuse, search, stats, topics
from folioscope.operators.embedding import Embedder
from folioscope.operators.filters import filter_papers, valid_embeddings
from folioscope.plans import incremental
from folioscope.schemas import EMBEDDED_PAPER, KEYED_PAPER, KEYS
from folioscope.session import cut
from folioscope.sources import corpus, manifest, snapshots, subjects

YearMonths = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class Explorer:
    """Tables below one root folder.

    ``upstream`` is the corpus as offered, ``landed`` the part taken over, ``embedded`` the part
    with vectors; ``layouts``, ``topics`` and ``published`` hold results. ``now`` is the present
    month, ``YYYY-MM``.
    """

    spark: SparkSession
    root: str
    embedder: Embedder
    now: str

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _listing(self, name: str, with_counts: bool = False) -> DataFrame:
        schema = EMBEDDED_PAPER if name == "embedded" else KEYED_PAPER
        return manifest.partition_manifest(self.spark, self._path(name), schema, with_counts)

    def manifest(self) -> DataFrame:
        """All partitions: upstream size, landed rows, landed and embedded or not."""
        return manifest.catalog_manifest(
            self._listing("upstream"), self._listing("landed", True), self._listing("embedded")
        )

    def subject_codes(self) -> DataFrame:
        """(code, name) rows; the codes upstream where no names are stored."""
        path = self._path("subject_codes.json")
        if corpus.path_exists(self.spark, path):
            return subjects.load_subject_codes(self.spark, path)
        return subjects.subject_codes_from(self._listing("upstream"))

    def status(self, categories: Sequence[str], year_months: YearMonths) -> DataFrame:
        """Grid of the categories and months with what the manifest knows."""
        chosen = self.spark.createDataFrame([(c,) for c in categories], "subject string")
        return catalog.grid_status(catalog.request_grid(chosen, year_months), self.manifest())

    def categories(self, year_months: YearMonths | None = None) -> DataFrame:
        """Every category with its name and its state over the months (this year's by default)."""
        months = year_months or catalog.default_months(self.now)
        codes = self.subject_codes()
        grid = catalog.request_grid(codes.select(F.col("code").alias("subject")), months)
        state = catalog.category_status(self._embedded_counts(grid))
        return state.join(codes.withColumnRenamed("code", "subject"), "subject")

    def _embedded_counts(self, grid: DataFrame) -> DataFrame:
        """Grid with the row counts of the embedded table."""
        counts = self._listing("embedded", True).select(*KEYS, F.col("n_rows").alias("n_embedded"))
        cells = catalog.grid_status(grid, self.manifest()).join(counts, list(KEYS), "left")
        n = F.when(F.col("embedded"), F.col("n_embedded")).otherwise(F.col("n_rows"))
        return cells.withColumn("n_rows", F.coalesce(n, F.lit(0))).drop("n_embedded")

    def months(self, year: str | None = None) -> DataFrame:
        return catalog.monthly_status(self.manifest(), self.now, year)

    def available_years(self) -> DataFrame:
        return catalog.availability(self._listing("upstream"), self._listing("landed"), ["year"])

    def available_months(self, year: str) -> DataFrame:
        sides = (self._listing(n).where(F.col("year") == year) for n in ("upstream", "landed"))
        return catalog.availability(*sides, ["month"])

    def estimate(self, categories: Sequence[str], year_months: YearMonths) -> DataFrame:
        """Papers and cost of a selection by category, by month and in total."""
        return catalog.estimate_cost(
            catalog.selection_counts(self.status(categories, year_months))
        )

    def cache_summary(self) -> DataFrame:
        return catalog.cache_summary(self.manifest())

    def land(
        self, categories: Sequence[str], year_months: YearMonths, force: bool = False
    ) -> DataFrame:
        """Take over upstream partitions that are not landed; returns those written."""
        upstream = corpus.read_corpus(self.spark, self._path("upstream"))
        staged = corpus.scan_selection(upstream, categories, year_months)
        return corpus.land_partitions(
            staged, self._path("landed"), self._listing("landed"), force
        )

    def embed(
        self, categories: Sequence[str], year_months: YearMonths, **options: int
    ) -> DataFrame:
        """Land, embed, assemble, lay out and publish a selection; returns the run's totals."""
        if not categories or not year_months:
            raise ValueError("no categories or no months selected")
        self.land(categories, year_months)
        return incremental.run(
            self.spark,
            self._path("landed"),
            self._path("embedded"),
            self._path("layouts"),
            self._path("published"),
            self.embedder,
            self.now,
            categories,
            year_months,
            **options,
        )

    def dataset(self) -> DataFrame:
        """The current dataset."""
        published = snapshots.read_published(self.spark, self._path("published"))
        if published is None:
            raise LookupError("no dataset is published")
        return published

    def _dataset_or_empty(self) -> DataFrame:
        """The current dataset, or no rows as long as none is published."""
        published = snapshots.read_published(self.spark, self._path("published"))
        if published is not None:
            return published
        none = self.spark.createDataFrame([], EMBEDDED_PAPER)
        return none.withColumns({"x": F.lit(None).cast("float"), "y": F.lit(None).cast("float")})

    def search(
        self,
        text: str,
        k: int = search.DEFAULT_K,
        year_months: Sequence[str] | None = None,
        categories: Sequence[str] | None = None,
    ) -> DataFrame:
        return search.search_text(self._dataset_or_empty(), text, self.embedder, k, year_months, categories)

    def papers(
        self, year_months: Sequence[str] | None = None, categories: Sequence[str] | None = None
    ) -> DataFrame:
        return listing.paper_listing(filter_papers(self._dataset_or_empty(), year_months, categories))

    def stats(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Totals, top subjects, papers per year-month."""
        papers = self.dataset()
        return stats.totals(papers), stats.top_subjects(papers), stats.month_counts(papers)

    def topics_status(self) -> DataFrame:
        return stats.topics_status(self.dataset())

    def extract_topics(
        self,
        n_components: int = 10,
        year_months: Sequence[str] | None = None,
        categories: Sequence[str] | None = None,
        min_documents: int = topics.MIN_DOCUMENTS,
    ) -> topics.TopicResult:
        """Terms, assignments and record, stored ones where the same papers were asked for before."""
        papers = filter_papers(self.dataset(), year_months, categories)
        n_valid = valid_embeddings(papers).count()
        if n_valid < n_components + 1:
            raise ValueError(f"{n_components} topics need {n_components + 1} papers with embeddings")
        request = reuse.dataset_fingerprint(papers, vectors=True).withColumn(
            "key",
            reuse.topics_key(F.lit(n_components), _list_or_null(year_months), _list_or_null(categories)),
        )
        request = cut(request, "topic-request")
        made_with = reuse.options_key(min_documents=min_documents, top_n=topics.TOP_TERMS)
        key, root = f'{request.first()["key"]}-{made_with}', self._path("topics")
        known = f"{root}/requests/key={key}"
        stored = snapshots.read_published(self.spark, known)
        if stored is not None:
            if reuse.topics_cache_valid(request, stored).first()["is_valid"]:
                return topics.load_topics(self.spark, root, key)
        state = f"{root}/passes/key={key}"
        found = topics.extract_topics(papers, n_components, min_documents=min_documents, state=state, key=key)
        topics.save_topics(found, root, key)
        snapshots.publish(request, known)
        return topics.load_topics(self.spark, root, key)


def _list_or_null(values: Sequence[str] | None) -> Column:
    if not values:
        return F.lit(None).cast("array<string>")
    return F.array(*[F.lit(v) for v in values])
