"""TTML subtitles as rows: one for each run of text of one colour."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the format, and what holds where a file says nothing.
NAMESPACE, STYLING, XML_ID = "{http://www.w3.org/ns/ttml}", "{http://www.w3.org/ns/ttml#styling}", "{http://www.w3.org/XML/1998/namespace}id"
WHITE, DEFAULT_PLACE = "#ffffff", ("bottom", 0.95)
RUNS = "para int, begin string, end string, anchor string, place double, line int, run int, text string, colour string"


def _percent(value: str | None) -> float | None:
    numbers = (value or "").split()
    try:
        return float(numbers[1].removesuffix("%")) / 100
    except (IndexError, ValueError):
        return None


def _place(region: dict[str, str]) -> tuple[str, float]:
    top, height = _percent(region.get(STYLING + "origin")), _percent(region.get(STYLING + "extent"))
    if top is None or height is None:
        return DEFAULT_PLACE
    return {"before": ("top", top), "center": ("center", top + height / 2)}.get(region.get(STYLING + "displayAlign") or "after", ("bottom", top + height))


class _Reader:
    """Takes a file's tags and text as they come and writes down runs. `around` holds the colour of each open element of a paragraph."""

    def __init__(self):
        self.styles: dict[str | None, dict[str, str]] = {}
        self.places: dict[str | None, tuple[str, float]] = {}
        self.around: list[str] = []
        self.rows: list[tuple] = []
        self.heard: list[str] = []
        self.cues = self.line = self.run = self.breaks = 0
        self.times: tuple | None = None  # of what is timed and open
        self.timed_at = 0

    def styled(self, attributes: dict[str, str], seen: frozenset = frozenset()) -> str | None:
        """A colour of one's own, else of the last style named that has one."""
        if own := attributes.get(STYLING + "color"):
            return "#" + own.removeprefix("#")[:6].lower()
        names = [n for n in (attributes.get("style") or "").split() if n in self.styles and n not in seen]
        return next((c for n in reversed(names) if (c := self.styled(self.styles[n], seen | {n}))), None)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self.said()
        name = tag.removeprefix(NAMESPACE)
        if name == "style":
            self.styles[attributes.get(XML_ID)] = attributes
        elif name == "region":
            self.places[attributes.get(XML_ID)] = _place(attributes)
        if name == "p" and not self.around:
            self.place, colour = self.places.get(attributes.get("region"), DEFAULT_PLACE), WHITE
        elif self.around:
            colour = self.around[-1]
        else:
            return
        self.around.append(self.styled(attributes) or colour)
        if name == "br":
            self.breaks += 1
            self.line, self.run = self.line + 1, 0
        elif not self.times and len(self.around) <= 2 and attributes.get("begin"):  # a paragraph, or what stands in one that has no time
            self.times, self.timed_at = (attributes["begin"], attributes.get("end")), len(self.around)
            self.line = self.run = 0

    def end(self, tag: str) -> None:
        self.said()
        if not self.around:
            return
        self.breaks -= tag == NAMESPACE + "br"
        if self.times and len(self.around) == self.timed_at:
            self.times = None
            self.cues += 1
        self.around.pop()

    def data(self, text: str) -> None:
        self.heard.append(text)

    def said(self) -> None:
        """What has been heard since the last tag is a run in the colour of the innermost open element."""
        text, self.heard = "".join(self.heard), []
        if text and self.times and not self.breaks:
            self.rows.append((self.cues, *self.times, *self.place, self.line, self.run, text, self.around[-1]))
            self.run += 1

    def close(self) -> list[tuple]:
        return self.rows


def ttml_runs(xml: str | None) -> list[tuple]:
    """The runs of a file, as RUNS lists them; none for a null or broken file."""
    parser = ElementTree.XMLParser(target=_Reader())
    try:
        parser.feed((xml or "").encode())
        return parser.close()
    except ElementTree.ParseError:
        return []


class TtmlRuns:
    """The table function behind `exploded`."""

    def eval(self, xml: str):
        yield from ttml_runs(xml)


def exploded(files: DataFrame, xml: str = "xml") -> DataFrame:
    """S7 + V10: files with a row for each run of their paragraphs; other columns stay. Files without runs have no row."""
    runs = F.udtf(TtmlRuns, returnType=RUNS)
    return files.lateralJoin(runs(F.col(xml).outer())).drop(xml)


def read_ttml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files as path and runs."""
    return exploded(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml")))
