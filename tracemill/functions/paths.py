"""Column helpers for corpus paths and file names."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dialect codes and their names.
DIALECTS = {
    "dr1": "new_england",
    "dr2": "northern",
    "dr3": "north_midland",
    "dr4": "south_midland",
    "dr5": "southern",
    "dr6": "new_york_city",
    "dr7": "western",
    "dr8": "army_brat",
}
#: Nationalities and their accents.
ACCENTS = {
    "USA": "american",
    "UK": "british",
    "Australia": "australian",
    "Canada": "canadian",
    "India": "indian",
    "Ireland": "irish",
    "South Africa": "south_african",
    "New Zealand": "new_zealand",
    "Scotland": "scottish",
    "Wales": "welsh",
}
SLICE = r"(?i)^(.*)_(\d+)_(\d+)\.wav$"


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder that holds the file, empty if there is none."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def with_suffix(path: Column, suffix: str) -> Column:
    """The last extension changed for ``suffix``, which is added where there is none."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.concat(bare, F.lit(suffix))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def relative(path: Column, root: str) -> Column:
    """The path below ``root``; as it is elsewhere. Local paths may have a scheme or not, as readers differ in that."""
    bare = (r"^(?:file:)?/+", "/")
    base = re.sub(*bare, root.rstrip("/")) + "/"
    once = lambda p: F.regexp_replace(p, *bare)
    return F.when(once(path).startswith(base), F.substr(once(path), F.lit(len(base) + 1))).otherwise(path)


def lookup(code: Column, names: Mapping[str, str]) -> Column:
    """The name of a code, empty if it has none."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit(""))


def dialect_path(path: Column) -> Column:
    """(speaker_id, dialect_code, dialect, split) of .../train/dr4/speaker/file; without that shape the parent is the speaker."""
    p = F.lower(slashed(path))
    whole = r"/(dr[1-8])/([^/]+)/[^/]+$"
    shaped = p.rlike(whole)
    code = F.when(shaped, F.regexp_extract(p, whole, 1)).otherwise(F.regexp_extract(p, r"/(dr[1-8])/", 1))
    speaker = F.when(shaped, F.regexp_extract(p, whole, 2)).otherwise(F.lower(parent(path)))
    split = F.when(p.contains("/train/"), "train").when(p.contains("/test/"), "test").otherwise("")
    return F.struct(speaker.alias("speaker_id"), code.alias("dialect_code"), lookup(code, DIALECTS).alias("dialect"), split.alias("split"))


def emotion_name(name: Column) -> Column:
    """(emotion, speech_type) of emo_<emotion>_<type>.wav; empty texts for other names."""
    p = r"(?U)^emo_(\w+)_(\w+)\."
    low = F.lower(name)
    return F.struct(F.regexp_extract(low, p, 1).alias("emotion"), F.regexp_extract(low, p, 2).alias("speech_type"))


def slice_name(name: Column) -> Column:
    """(base, start, end) of <base>_<start>_<end>.wav; null for other names."""
    return F.when(name.rlike(SLICE), F.struct(F.regexp_extract(name, SLICE, 1).alias("base"), F.regexp_extract(name, SLICE, 2).try_cast("long").alias("start"), F.regexp_extract(name, SLICE, 3).try_cast("long").alias("end")))


def corpus_of(path: Column) -> Column:
    """Which corpus a path belongs to: timit with 3 parts or more, else ears with 4 or more, else null."""
    p, depth = F.lower(slashed(path)), F.size(F.split(slashed(path), "/"))
    return F.when(p.contains("timit"), F.when(depth >= 3, "timit")).when(p.contains("ears") & (depth >= 4), "ears")


def prepared_path(path: Column) -> Column:
    """Where a prepared file goes: ears files under ears_dataset, timit files where they are; null without a corpus."""
    p = slashed(path)
    return F.when(corpus_of(path) == "ears", F.concat(F.lit("ears_dataset/"), F.regexp_replace(p, r"^[^/]*/", ""))).when(corpus_of(path) == "timit", p)


def source_path(path: Column) -> Column:
    """Where the original of a timit file is: its split in capitals; of an ears file: its speaker's unsliced recording."""
    parts = F.split(slashed(path), "/")
    cut = slice_name(file_name(slashed(path)))
    timit = F.concat(F.upper(parts[1]), F.lit("/"), F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/"))
    return F.when(corpus_of(path) == "timit", timit).when((corpus_of(path) == "ears") & cut.isNotNull(), F.concat(parts[2], F.lit("/"), cut["base"], F.lit(".wav")))


def clamp_slice(samples: Column, start: Column, end: Column) -> Column:
    """The samples from ``start`` to ``end``, or to the last one if ``end`` lies beyond."""
    upto = F.least(end, F.size(samples).cast("long"))
    return F.slice(samples, (start + 1).cast("int"), F.greatest(upto - start, F.lit(0)).cast("int"))


def handle_parts(handle: Column) -> Column:
    """(p1, p2, rest) of <p1>_<p2>_<rest>; null without a second part."""
    parts = F.split(handle, "_", 3)
    return F.when(F.size(parts) >= 2, F.struct(parts[0].alias("p1"), parts[1].alias("p2"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")).alias("rest")))


def handle_folder(handle: Column) -> Column:
    h = handle_parts(handle)
    return F.concat_ws("/", F.lit("train/audio"), h["p1"], h["p2"])


def language_of(folder: Column) -> Column:
    """The language in mls_<language> or <language>_low_resource; empty for other names."""
    return F.when(folder.rlike(r"^mls_"), F.regexp_extract(folder, r"^mls_(.+)$", 1)).otherwise(F.regexp_extract(folder, r"^(.+)_low_resource$", 1))
