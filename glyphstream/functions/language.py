"""Language codes: ISO 639-2 to the two letters of ISO 639-1."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The bibliographic codes of ISO 639-2 that differ from the terminological ones.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de",
    "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}
# Serbo-Croatian has a two-letter code that Java leaves out; Bihari's and Moldavian's are withdrawn.
ADDED, WITHDRAWN, OLD = {"hbs": "sh"}, {"bih", "mol"}, {"iw", "in", "ji"}


def language_table(spark: SparkSession) -> dict[str, str]:
    """Three letters to two, by rule from the JVM's ISO 639 list."""
    locale = spark._jvm.java.util.Locale
    found = {locale(two).getISO3Language(): two for two in locale.getISOLanguages() if two not in OLD}
    return {k: v for k, v in found.items() if k not in WITHDRAWN} | BIBLIOGRAPHIC | ADDED


def normalize_language(code: Column, spark: SparkSession | None = None) -> Column:
    """The primary subtag in lower case, in two letters where there are; what follows it unchanged."""
    table = language_table(spark or SparkSession.active())
    known = F.create_map(*map(F.lit, chain.from_iterable(sorted(table.items()))))
    primary = F.lower(F.substring_index(code, "-", 1))
    tail = F.substr(code, F.length(F.substring_index(code, "-", 1)) + 1)
    return F.concat(F.coalesce(F.try_element_at(known, primary), primary), tail)
