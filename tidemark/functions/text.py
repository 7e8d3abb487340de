"""Slugs, names, labels and lists of text, as built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin-1 letters and their ASCII equivalents; two-letter ones apart.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
PAIRS = {"Æ": "Ae", "Ð": "Th", "Þ": "th", "ß": "ss", "æ": "ae", "ð": "th", "þ": "th"}
LONGEST, SHORTEST = 90, 2


def _folded(text: Column) -> Column:
    """Latin-1 letters to ASCII; few texts have letters that become two."""
    one = F.translate(text, ACCENTED, PLAIN)
    two = one
    for letter, pair in PAIRS.items():
        two = F.replace(two, F.lit(letter), F.lit(pair))
    return F.when(text.rlike(f"[{''.join(PAIRS)}]"), two).otherwise(one)


def ascii_fold(text: Column) -> Column:
    """Latin-1 letters to ASCII; what else lies beyond ASCII is dropped."""
    return F.regexp_replace(_folded(text), r"[^\x00-\x7F]", "")


def slug(title: Column, longest: int = LONGEST) -> Column:
    """A name for a title: lower case with hyphens, at most ``longest`` characters but with a year at its end kept, padded to two with ``_``.

    Blanks, full stops, colons, slashes and hyphens part words; other characters than letters, digits and ``_`` vanish from them.
    """
    letters = F.lower(F.regexp_replace(_folded(title), r"[^A-Za-z0-9_ .:/-]+", ""))
    name = F.btrim(F.regexp_replace(letters, r"[ .:/-]+", "-"), F.lit("-"))
    year = F.regexp_extract(name, r"[-_](\d{2,4}(?:-\d{2,4})?)$", 1)
    kept = F.concat(F.left(name, F.lit(longest - 1) - F.length(year)), F.lit("-"), year)
    cut = F.when(F.length(name) <= longest, name).when(year == "", F.left(name, F.lit(longest))).otherwise(kept)
    return F.rpad(cut, F.greatest(F.length(cut), F.lit(SHORTEST)), F.lit("_"))


def slug_suffix(name: Column, key: Column) -> Column:
    """The name with five characters of its key's hash, alike on every run."""
    return F.concat(name, F.lit("-"), F.left(F.sha2(key, 256), F.lit(5)))


def flag(text: Column) -> Column:
    """True or false as people write them; null for anything else."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("1", "true", "t", "yes", "on"), True).when(word.isin("0", "false", "f", "no", "off"), False)


def munged_name(name: Column) -> Column:
    """Lower case, words joined by ``_``, without slashes."""
    return F.replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_"), F.lit("/"), F.lit(""))


def label(column_name: Column) -> Column:
    """A column's name as a heading."""
    return F.initcap(F.replace(column_name, F.lit("_"), F.lit(" ")))


def listed(text: Column, separator: str = r"[,\s]+") -> Column:
    """A list of addresses or names from text, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def messages(text: Column) -> Column:
    """The single messages of a joined one."""
    return F.split(text, "::")


def warnings_and_errors(lines: Column) -> Column:
    """Of a list of lines those that say WARNING or ERROR, joined."""
    return F.array_join(F.filter(lines, lambda x: x.contains("WARNING") | x.contains("ERROR")), ", ")


def or_na(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("N/A"))


def task_job_id(name: Column) -> Column:
    """The job's id in a task's name, null where there is none."""
    return F.nullif(F.regexp_extract(name, r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1), F.lit(""))


def extra(extras: Column, key: str) -> Column:
    """The value of the first of an array of (key, value) structs with that key."""
    return F.get(F.filter(extras, lambda x: x["key"] == key), F.lit(0))["value"]
