"""String functions: names, sizes, ids, dates and labels as Columns; accent folding and fuzzy scores as pandas UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English names and the official ones that the boundary tables hold, both folded.
EXONYMS = {
    "germany": "deutschland", "spain": "espana", "italy": "italia", "greece": "ellada", "austria": "osterreich", "switzerland": "schweiz",
    "finland": "suomi", "poland": "polska", "czechia": "cesko", "czech republic": "cesko", "hungary": "magyarorszag", "belgium": "belgique",
    "netherlands": "nederland", "sweden": "sverige", "norway": "norge", "croatia": "hrvatska", "cologne": "koln", "munich": "munchen",
    "vienna": "wien", "rome": "roma", "milan": "milano", "florence": "firenze", "venice": "venezia", "naples": "napoli", "turin": "torino",
    "prague": "praha",
}
GEOCODE_CUTOFF, SEARCH_CUTOFF, SUGGEST_CUTOFF = 0.9, 0.8, 0.6


@F.pandas_udf(StringType())
def fold(names: pd.Series) -> pd.Series:
    """Without accents, trimmed and lower-cased."""
    import unicodedata

    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).strip().lower()
    return names.map(plain, na_action="ignore")


def similarity(names: Column, query: str) -> Column:
    """The matching ratio of each name with the query: twice the matched characters by all characters."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        m = SequenceMatcher()
        m.set_seq2(query)

        def of(s):
            m.set_seq1(s)
            return m.ratio()

        return x.map(of, na_action="ignore").astype("float64")

    return ratio(names)


def name_variants(name: Column) -> Column:
    """An array of a name's parts at slashes, each whole and up to its first comma."""
    parts = F.transform(F.split(name, "/"), F.trim)
    heads = F.transform(parts, lambda x: F.trim(F.element_at(F.split(x, ","), 1)))
    return F.filter(F.array_union(parts, heads), lambda x: x != "")


def stable_id(filename: Column) -> Column:
    """The first four bytes of the name's SHA-1 as an unsigned number."""
    return F.conv(F.substring(F.sha1(filename), 1, 8), 16, 10).cast("long")


#: Fixed value: the file names of the archive.
LISTED = r"^WD_MERGE_(\d{4}-\d{2}-\d{2})---(\d{4}-\d{2}-\d{2}).*?_cluster_(\d+).*?\.tif$"
#: Fixed value: a size in a directory listing.
SIZE = r"^\s*([\d.]+)\s*([KMGT])?\s*$"


def listing_field(filename: Column, part: str) -> Column:
    """start, end or cluster of a raster's file name, null where the name has none."""
    found = F.regexp_extract(filename, LISTED, {"start": 1, "end": 2, "cluster": 3}[part])
    return F.when(found != "", found)


def parse_size(text: Column) -> Column:
    """Bytes of a listing's size such as 1.2G or 512, in powers of 1024; null where it does not parse."""
    number, unit = F.regexp_extract(text, SIZE, 1), F.regexp_extract(text, SIZE, 2)
    scale = F.when(unit == "K", 2.0**10).when(unit == "M", 2.0**20).when(unit == "G", 2.0**30).when(unit == "T", 2.0**40).otherwise(1.0)
    return F.floor(number.try_cast("double") * scale).cast("long")


def norm_start(text: str | None) -> str | None:
    """A bare year starts on its first day."""
    return f"{text}-01-01" if text and len(text) == 4 else text


def norm_end(text: str | None) -> str | None:
    return f"{text}-12-31" if text and len(text) == 4 else text


def is_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def when_label(dates: Column) -> Column:
    """One date as it is, several as first to last year."""
    sorted_ = F.array_sort(F.array_distinct(dates))
    year = lambda i: F.substring(F.element_at(sorted_, i), 1, 4)
    return F.when(F.size(sorted_) == 1, F.element_at(sorted_, 1)).when(F.size(sorted_) > 1, F.concat(year(1), F.lit("-"), year(-1)))


def nuts_id(text: Column) -> Column:
    code = F.upper(F.trim(text))
    return F.when(code.rlike(r"^[A-Z]{2}[A-Z0-9]{0,3}$"), code)


def nuts_level(code: Column) -> Column:
    return F.length(code) - 2
