"""Venue and year of a document as a plan: records of its first page as rows, rules as columns, evidence as rows, a decision by aggregation.

Everything is keyed by ``key``; a document's rows meet only in windows and aggregations on that key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse, let, strip

# --- Fixed values: patterns that decide what names a venue or dates a publication ---

LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
AFFILIATION = (
    r"(?iU)\b(?:universit\w*|institute|institution|dept\.?|department|faculty|school|college|laborator\w*|research|centre|center|campus|association|society|"
    r"conference|symposium|workshop|proceedings|corporation|company|corp\.?|inc\.?|ltd\.?|llc|unaffiliated|informatics|engineering|computer science|"
    r"information security group|web services|agency|technology|CISPA|FORTH|Fraunhofer|ETH|MIT|UC|SAP SE)\b|大学|大学院|研究科|学部|研究所|情報基盤|センター|機構"
)
FRONT_HEADING = r"(?iU)\A\s*(?:abstract\b|summary\s*[:：]?$|概要|要旨|あらまし|(?:\d{1,2}[.)]?\s*)?(?:introduction|はじめに)\b)"
NO_DATE = r"(?iU)arxiv|access(?:ed)?|retriev(?:ed|al)|download(?:ed)?|received|accepted|submitted|revised|reprinted from|version of|abridged version|appears in|受付|受理"
YEAR = r"(?U)\b((?:19|20)\d{2})\b"
MONTH = r"(?iU)\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b"
ORDINAL = (
    r"(?:\d+(?:st|nd|rd|th)|First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|Eleventh|Twelfth|Thirteenth|Fourteenth|Fifteenth|Sixteenth|"
    r"Seventeenth|Eighteenth|Nineteenth|Twentieth)"
)
KNOWN_VENUES = (
    r"USENIX Security Symposium",
    r"Symposium on Usable Privacy and Security",
    r"Network and Distributed System Security\s*\(NDSS\)\s*Symposium",
    r"NDSS(?=\s+[’']?\d{2,4}\b)",
    r"ESORICS(?=\s+20\d{2}\b)",
    r"Computer Security Symposium",
    r"情報処理学会第\d+回全国大会",
    r"WWW(?=\s+20\d{2}\b)",
)
NO_VENUE = r"(?iU)\A(?:\[\d+\]|\d+\.)|\b(?:we|our|evaluate|discuss|previous|cited|references|bibliography)\b"
BEFORE_KNOWN = rf"(?iUs)\A(?:{ORDINAL}|.*proceedings(?: of)?(?: the)?\s*(?:{ORDINAL})?|.*\(Eds?\.\):)?\z"
PUBLISHED_AT = r"(?iU)^(?:paper )?published (?:at|in)\s+(.{3,160}?)(?:\.|$)"
MEETING_NAME = r"(?iU)conference|symposium|workshop|journal|proceedings|\A[a-z][a-z-]+\s+[’']?\d{2,4}\z"
PUBLISHER = r"(?iU)universit|institute|company|publisher|\bpress\b|copyright"
VOLUME_OF = r"(?iU)^(.{3,120}?)\s*,?\s*(?:vol\.?\s*\d+|\d+\s*\(\d+\)\s*:)"
SERIAL = r"(?iU)\b(?:journal|jurnal|transactions|annals|letters|review|bulletin|magazine)\b|Information and Media Technologies|コンピュータソフトウェア"
RIGHTS = r"(?iU)copyright|©|https?://"
MEETING = r"(?iU)\A(?:proceedings of (?:the )?|(?:\d+(?:st|nd|rd|th) )?)([^\n]{3,150}?\b(?:conference|workshop|symposium)(?: on [^\n]{3,100})?)(?:\s+\(?20\d{2}\)?|[.,]|$)"
HOST = r"(?iU)university|institute|company|copyright"
CAPITALISED = r"(?U)\A(?:(?:(?i:on|of|the|and|in|for|conference|symposium|workshop)|\p{IsUppercase}\S*)(?:\s+|\z))+\z"
VOLUME = r"(?iU)\bvol\.?|\d+\(\d+\)"
PROCEEDINGS = r"(?iU)proceedings of (?:the|a)\b"
PUBLISHED_FIELD = r"(?iU)(?:^|;\s*)published\s*[:：]\s*(.*?)(?=;|copyright|©|$)"
PUBLISHED_YEAR = r"(?iU)^published\s*[:：]?\s*(?:19|20)\d{2}\b"
COPYRIGHT_LINE = r"(?iU)^(?:copyright|©|\(c\)|c\s*⃝)"
COPYRIGHT = r"(?iU)copyright|©|\(c\)"
STATED_DATE = r"\A(?:19|20)\d{2}(?:-\d{2}(?:-\d{2})?)?\z"
STATED_TIME = r"\A(?:19|20)\d{2}-\d{2}-\d{2}T(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?\z"
PROPERTIES = ("year", "publicationyear", "publicationdate")
HEADER, PUBLICATION, JOURNAL, DATED_COVER, RIGHTS_LINE, PROPERTY = (
    "first page proceedings header", "first page publication header", "first page journal header", "first page proceedings date", "first page copyright line", "PDF metadata",
)
#: Characters of a line that may pair with its neighbour, of a dated line on a cover, and of a record that names a known venue; share of the page below which a venue is a footer.
PAIRED, DATED, KNOWN, FOOTER = 160, 140, 450, 0.65


@dataclass(frozen=True)
class Rule:
    """A record in which ``pattern`` is found names a venue (its group ``group``, less ``ends``), if the name passes ``wanted`` and none of ``barred``, and what stands ahead of it passes ``ahead``."""

    source: str
    pattern: str
    group: int = 1
    wanted: tuple[str, ...] = ()
    barred: tuple[str, ...] = ()
    ahead: str | None = None
    ends: str = ""
    longest: int | None = None

    def read(self, record: Column) -> Column:
        name = strip(F.regexp_extract(record, self.pattern, self.group))
        if self.ends:
            name = F.btrim(name, F.lit(self.ends))
        good = record.rlike(self.pattern) & (name != "")
        for pattern in self.wanted:
            good = good & name.rlike(pattern)
        for pattern in self.barred:
            good = good & ~name.rlike(pattern)
        if self.ahead is not None:
            good = good & strip(F.get(F.split(record, self.pattern, 2), 0)).rlike(self.ahead)
        if self.longest is not None:
            good = good & (F.length(record) <= self.longest)
        return F.when(good, F.struct(name.alias("name"), F.lit(self.source).alias("source")))


#: In order: the first rule that reads a record decides.
RULES = (
    *(Rule(HEADER, f"(?iU){known}", 0, ahead=BEFORE_KNOWN, longest=KNOWN) for known in KNOWN_VENUES),
    Rule(PUBLICATION, PUBLISHED_AT, wanted=(MEETING_NAME,), barred=(PUBLISHER,)),
    Rule(JOURNAL, VOLUME_OF, wanted=(SERIAL,), barred=(AFFILIATION, RIGHTS), ends=" ,;:-"),
    Rule(HEADER, MEETING, wanted=(CAPITALISED,), barred=(HOST,)),
)
#: In lower case: one of the first is in all that the rules for meetings read, one of the second in all that the rule for serials does.
MEETING_WORDS = ("symposium", "conference", "workshop", "published", "ndss", "esorics", "www", "情報処理学会第")
SERIAL_WORDS = ("journal", "jurnal", "transactions", "annals", "letters", "review", "bulletin", "magazine", "information and media technologies", "コンピュータソフトウェア")
#: Years of a record that names a venue weigh by its kind; records that name none by what they are.
VENUE_PRIORITY = {JOURNAL: 4}
OTHER_VENUE, FIELD_PRIORITY, PROPERTY_PRIORITY = 3, 4, 2


def flat(block: Column) -> Column:
    """Whether a block is set horizontally."""
    return (block["direction"]["dx"] >= 0.95) & (F.abs(block["direction"]["dy"]) <= 0.1)


def lines_of(text: Column) -> Column:
    """A text's lines, stripped, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), strip), lambda x: x != "")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def hinted(record: Column) -> Column:
    """Whether a record holds words without which no rule reads it: a cheap look that spares most records the rules' patterns."""
    # Further letters that a pattern without case takes for s, i and k.
    for letter, plain in (("\u017f", "s"), ("\u0130", "i"), ("\u0131", "i"), ("\u212a", "k")):
        record = F.replace(record, F.lit(letter), F.lit(plain))
    return let(F.lower(record), lambda low: holds(low, MEETING_WORDS) | (holds(low, ("vol", "(")) & holds(low, SERIAL_WORDS)))


def venue_of(record: Column) -> Column:
    """``name, source`` of the venue that a record names, or null."""
    return F.when(hinted(record) & ~record.rlike(NO_DATE) & ~record.rlike(NO_VENUE), F.coalesce(*[rule.read(record) for rule in RULES]))


def is_cover(text: Column) -> Column:
    return F.coalesce(text.rlike(PROCEEDINGS), F.lit(False)) & ~F.exists(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), lambda x: x.rlike(FRONT_HEADING))


def records(pages: DataFrame) -> DataFrame:
    """``key, record, place``: lines, horizontal blocks and pairs of short neighbouring lines of each page ``(key, text, blocks)``, each text once, at its first place."""
    lines = pages.select("key", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    lines = lines.withColumn("next", F.lead("line").over(Window.partitionBy("key").orderBy("at")))
    pair = F.when((F.length("line") < PAIRED) & (F.length("next") < PAIRED), F.concat_ws(" ", "line", "next"))
    place = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("at").alias("at"))
    of_lines = lines.select("key", F.explode(F.array(F.struct(place(0).alias("place"), F.col("line").alias("record")), F.struct(place(2).alias("place"), pair.alias("record")))).alias("r"))
    of_blocks = pages.select("key", F.posexplode("blocks").alias("at", "b")).where(flat(F.col("b"))).select("key", F.struct(place(1).alias("place"), collapse(F.col("b.text")).alias("record")).alias("r"))
    rows = of_lines.unionByName(of_blocks).select("key", "r.place", "r.record").where(F.col("record") != "")
    return rows.groupBy("key", "record").agg(F.min("place").alias("place"))


def located(pages: DataFrame) -> DataFrame:
    """:func:`records` with ``cover`` of the page and, where a record names one, ``venue`` and ``source`` by where it stands: cover, footer or header."""
    found = records(pages).withColumn("v", venue_of(F.col("record")))
    tops = F.transform(F.coalesce("blocks", F.array().cast(pages.schema["blocks"].dataType)), lambda b: F.struct(F.lower(collapse(b["text"])).alias("text"), b["y0"].alias("y0")))
    page = pages.select("key", is_cover(F.col("text")).alias("cover"), tops.alias("tops"), F.array_max(F.transform("blocks", lambda b: b["y1"])).alias("bottom"))
    joined = found.join(page, "key")
    top = F.array_min(F.transform(F.filter("tops", lambda b: F.contains(b["text"], F.lower("v.name"))), lambda b: b["y0"]))
    stands = F.when(F.col("cover"), "cover").when(top > FOOTER * F.col("bottom"), "footer").otherwise("header")
    source = F.when(F.col("v.source") == HEADER, F.regexp_replace(F.col("v.source"), F.lit("header$"), stands)).otherwise(F.col("v.source"))
    return joined.select("key", "record", "place", "cover", F.col("v.name").alias("venue"), source.alias("source"))


def venues(found: DataFrame) -> DataFrame:
    """``key, venue, source``: of :func:`located` records the first that names one, those of a volume first."""
    best = F.min_by(F.struct("venue", "source"), F.struct(~F.col("record").rlike(VOLUME), F.col("place")))
    return found.where("venue IS NOT NULL").groupBy("key").agg(best.alias("v")).select("key", "v.*")


def stated_years(value: Column) -> Column:
    """Years of a property, if all of it is explicit years or valid ISO dates and times."""
    items = F.transform(F.split(value, ";"), strip)
    valid = lambda x: (x.rlike(STATED_DATE) | x.rlike(STATED_TIME)) & F.left(x, F.lit(10)).try_cast("date").isNotNull()
    return F.when(F.forall(items, valid), F.array_distinct(F.transform(items, lambda x: F.left(x, F.lit(4)).cast("int"))))


def evidence(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``key, priority, year, source, place``: what dates a document, 4 publication, 3 proceedings, 2 property, 1 copyright.

    ``pages`` has ``key`` and ``properties``, ``found`` are its :func:`located` records.
    """
    r = F.col("record")
    span = lambda priority, source, text: F.struct(F.lit(priority).alias("priority") if isinstance(priority, int) else priority.alias("priority"), (F.lit(source) if isinstance(source, str) else source).alias("source"), text.alias("text"))
    weight = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in VENUE_PRIORITY.items()], F.lit(OTHER_VENUE))
    dated = (
        F.when(F.col("venue").isNotNull(), span(weight, F.col("source"), F.get(F.split(r, COPYRIGHT, 2), 0)))
        .when(r.rlike(PUBLISHED_YEAR), span(4, PUBLICATION, r))
        .when(F.col("cover") & r.rlike(MONTH) & (F.length(r) < DATED) & ~r.rlike(RIGHTS.replace("|https?://", "")), span(3, DATED_COVER, r))
        .when(r.rlike(COPYRIGHT_LINE), span(1, RIGHTS_LINE, r))
    )
    field = F.when(r.rlike(PUBLISHED_FIELD), span(FIELD_PRIORITY, PUBLICATION, F.regexp_extract(r, PUBLISHED_FIELD, 1)))
    spans = found.where(holds(r, ("19", "20")) & r.rlike(YEAR)).select("key", "place", F.explode(F.array_compact(F.array(field, F.when(~r.rlike(NO_DATE), dated)))).alias("s"))
    printed = spans.select("key", "s.priority", F.explode(F.regexp_extract_all("s.text", F.lit(YEAR), F.lit(1)).cast("array<int>")).alias("year"), "s.source", "place")
    by_property = F.posexplode(F.array(*[stated_years(F.col("properties")[p]) for p in PROPERTIES]))
    stated = pages.select("key", by_property.alias("at", "years")).select("key", F.lit(PROPERTY_PRIORITY).alias("priority"), F.explode("years").alias("year"), F.lit(PROPERTY).alias("source"), F.struct(F.lit(3).alias("kind"), "at").alias("place"))
    return printed.unionByName(stated)


def agreed(rows: DataFrame) -> DataFrame:
    """``key, year, source``: the year on which all evidence of a document's highest priority agrees; documents whose best evidence disagrees are left out.

    Of two kinds of evidence in one record, a field that states the publication names the source.
    """
    ranks = rows.groupBy("key", "priority").agg(F.min("year").alias("low"), F.max("year").alias("high"), F.min_by("source", F.struct("place", F.col("source") != PUBLICATION)).alias("source"))
    best = ranks.groupBy("key").agg(F.max_by(F.struct("low", "high", "source"), "priority").alias("b"))
    return best.where("b.low = b.high").select("key", F.col("b.low").alias("year"), "b.source")
