"""From pages, layouts and texts to resolved figure mentions, summaries and display documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.operators import captions, display, layout, mapping, raw, references, reports, structure
from marlgate.storage import cut, unbucketed


@dataclass
class Analysis:
    """The tables of an analysis, all lazy but three.

    ``carried`` (a row for each page) and ``entries`` (the ranked registry) are read by several steps, and written to the shared folder
    when they are first asked for.  ``stored_mapped`` and ``stored_figures`` are for nested results, which read mentions and figures
    more than once.  A result that does not need them does not work them out.  The texts are best a stored table.

    With ``parts`` all that is stored is dealt over so many buckets by document.  Where the texts are, too, no step moves rows between
    tasks: pages, figures, mentions and their lookups all lie with their document.
    """

    pages: DataFrame
    layouts: DataFrame
    texts: DataFrame
    exclude_captions: bool = False
    parts: int | None = None
    scanned: DataFrame | None = None  # the texts as the scan for mentions reads them, if not as ``texts``

    def _cut(self, table: DataFrame, name: str) -> DataFrame:
        return cut(table, name) if self.parts is None else cut(table, name, "doc_id", self.parts)

    @cached_property
    def figures(self) -> DataFrame:
        layouts = self.layouts if self.parts is None else self.layouts.repartition(self.parts, "doc_id")  # none but figures are moved, if any
        return layout.figure_layouts(layouts)

    @cached_property
    def structure(self) -> DataFrame:
        return structure.page_structure(self.pages, self.texts, self.layouts)

    @cached_property
    def carried(self) -> DataFrame:
        """The structure of pages with what they inherit."""
        return self._cut(structure.carry_forward(self.structure), "carried")

    @cached_property
    def captions(self) -> DataFrame:
        return captions.best_captions(self.figures, self.texts)

    @cached_property
    def below(self) -> DataFrame:
        return captions.captions_below(self.figures, self.texts)

    @cached_property
    def named_figures(self) -> DataFrame:
        return captions.name_figures(captions.with_texts(self.figures, self.texts), None, self.carried)

    @cached_property
    def stored_figures(self) -> DataFrame:
        return self._cut(self.named_figures, "figures")

    @cached_property
    def entries(self) -> DataFrame:
        """The registry with the ranks that lookups go by."""
        figures = self.__dict__.get("stored_figures", self.named_figures)
        return self._cut(mapping.ranked(mapping.figure_registry(figures, self.carried), self.parts), "entries")

    @cached_property
    def registry(self) -> DataFrame:
        return self.entries.drop("in_chapter", "by_number", "n")

    @cached_property
    def refs(self) -> DataFrame:
        """The mentions, without the context of their pages."""
        return self._scan(self.texts if self.scanned is None else self.scanned)

    def _scan(self, texts: DataFrame) -> DataFrame:
        if self.exclude_captions:
            used = self.captions.select("doc_id", "page_index", "text_idx").distinct()
            texts = texts.join(used, ["doc_id", "page_index", "text_idx"], "left_anti")
        return references.scan_references(texts)

    @cached_property
    def refs_in_context(self) -> DataFrame:
        """The mentions with the chapter and section of their own pages."""
        return references.with_page_context(self.refs, self.structure)

    @cached_property
    def mapped(self) -> DataFrame:
        """The mentions with context and figures."""
        return mapping.map_references(self.refs, self.entries, self.carried)

    @cached_property
    def stored_mapped(self) -> DataFrame:
        return self._cut(self.mapped, "mapped")

    @cached_property
    def mapped_numbers(self) -> DataFrame:
        """The numbers that pages mention, with figures: what counts of mentions need."""
        return mapping.map_references(mapping.numbers_of_pages(self._scan(self.texts)), self.entries, self.carried)

    @cached_property
    def counts(self) -> DataFrame:
        refs = self.__dict__["stored_mapped"] if "stored_mapped" in self.__dict__ else self._scan(self.texts)  # a row for a mention each
        return reports.page_counts(self.pages, self.layouts, self.figures, self.texts, refs)

    @cached_property
    def summary(self) -> DataFrame:
        return reports.document_summary(self.counts)

    @cached_property
    def chapters(self) -> DataFrame:
        return reports.chapter_summary(self.carried, self.registry)

    @cached_property
    def figure_list(self) -> DataFrame:
        mapped = self.__dict__["stored_mapped"] if "stored_mapped" in self.__dict__ else self.mapped_numbers
        shown = mapped.join(display.shown_pages(self.pages).select("doc_id", "page_index").hint("shuffle_hash"), ["doc_id", "page_index"], "left_semi")
        return display.display_figures(self.pages, self.__dict__.get("stored_figures", self.named_figures), mapping.reference_counts(shown))

    @cached_property
    def elements(self) -> DataFrame:
        figures, mapped = (self.__dict__.get(stored, lazy) for stored, lazy in (("stored_figures", self.named_figures), ("stored_mapped", self.mapped)))
        return display.layout_elements(self.pages, self.texts, figures, mapped, structure=self.carried)

    @cached_property
    def bare_elements(self) -> DataFrame:
        """The elements of shown pages, for counts: no lookups are made."""
        return display.bare_elements(self.pages, self.texts, self.figures, self._scan(self.texts))

    @cached_property
    def raw(self) -> DataFrame:
        figures, mapped = self.stored_figures, self.stored_mapped
        return raw.to_raw(self.pages, self.layouts, self.texts, figures, mapped, self.carried, self.chapters, self.summary)

    def display(self, documents: DataFrame | None = None, only: tuple[str, ...] = ("chapters", "layouts", "full_text", "figures")) -> DataFrame:
        """Nested documents; ``documents`` has doc_id, title, total_pages and processing_time.

        Of chapters, layouts and full texts of pages, and figures those in ``only`` are made: mentions are resolved for layouts and
        figures alone, and stored where both read them.  Pages are always there.
        """
        if documents is None:
            documents = self.pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"))
            documents = documents.select("doc_id", F.lit(None).cast("string").alias("title"), "total_pages", F.lit(None).cast("double").alias("processing_time"))
        if "layouts" in only or "figures" in only:
            _ = self.stored_figures
        if "layouts" in only and "figures" in only:
            _ = self.stored_mapped
        return display.to_display(
            documents, self.pages, self.carried,
            reports.chapter_spans(self.carried) if "chapters" in only else None,
            self.figure_list if "figures" in only else None,
            self.elements if "layouts" in only else None,
            self.texts if "full_text" in only else None,
        )


def fixture_analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """The analysis of the fixture's documents."""
    from marlgate.sources.fixtures import fixture_layouts, fixture_pages, fixture_texts

    texts = fixture_texts(spark, sf_dir)
    return Analysis(fixture_pages(texts), fixture_layouts(texts), texts)


def stored_fixture(spark: SparkSession, sf_dir: str) -> Analysis:
    """The same over written texts, for results that read them more than once: pages and layouts are made from them as they are read."""
    from marlgate.sources.fixtures import fixture_layouts, fixture_pages, fixture_parts, fixture_texts

    # joins by page, and unions, go by the documents' partitions
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    parts = fixture_parts(spark, sf_dir)
    texts = cut(fixture_texts(spark, sf_dir), "texts", "doc_id", parts)
    # the scan for mentions deals the texts once more, as it did: a text is less than the mentions in it, which then stay where they are
    return Analysis(fixture_pages(texts), fixture_layouts(texts), texts, parts=parts, scanned=unbucketed(texts).repartition(parts, "doc_id"))
