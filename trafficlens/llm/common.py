"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.archive import materialise, shared_dir

__all__ = ["Lookup", "Memo", "file_system", "fresh", "kept_by", "materialise", "per_process", "row_key", "shared_dir", "splitter", "table",
           "unique_name", "word_hashes", "words_in"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], base: str) -> str:
    """A column name that no present column has (Spark compares them without case)."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Scripts that put no space between words (Thai, Lao, Burmese, Khmer, kana, Chinese characters).
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
WORD = rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+"


def splitter(text: str):
    """What cuts a text into words: white space, and in scripts without spaces every character is one."""
    import re
    try:
        text.encode("latin-1")  # most texts hold none of those scripts, and this is a fast way to know
    except UnicodeEncodeError:
        if re.search(f"[{_UNSPACED}]", text):
            return re.compile(WORD).findall
    return str.split


def words_in(text: str) -> list[str]:
    return splitter(text)(text)


def row_key(text: Column) -> Column:
    """Tells apart rows that share an id but not their text; null and empty texts differ."""
    return F.xxhash64(text, text.isNull())


def unique_name(part: int, suffix: str) -> str:
    """File name of one task attempt: a repeated attempt never touches the files of another."""
    return f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def file_system(path: str):
    """File system and path of a folder or file in a shared store (file, hdfs, s3 and so on)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def per_process(name: str, make):
    """A value that one Python process makes once and keeps over its tasks.

    Functions of this package travel to the workers by value, so a global of a module would be made anew by each task.
    """
    import sys
    import types
    held = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def kept_by(owner: str, name: str, make):
    """A table that a worker keeps for one operator, until another operator asks for tables of its own.

    Workers outlive the stages of a job, so tables that all operators left behind would add up.
    """
    held = per_process("tables of one owner", lambda: {"owner": None, "tables": {}})
    if held["owner"] != owner:
        held["tables"].clear()
        held["owner"] = owner
    if name not in held["tables"]:
        held["tables"][name] = make()
    return held["tables"][name]


TABLE_BYTES = 32 << 20  # of one table of a worker
LONGEST = 256           # characters of a string that is worth keeping
_ENTRY = 100            # bytes of an entry of a dict, about


class Memo:
    """Values of strings by ``make(list of missing strings)``, of which a worker keeps about ``limit`` bytes.

    The limit bounds memory only, and every value is as it would be without a memo. Values wait in one of two tables:
    when the younger is half the limit, it becomes the older, and the older one goes, so that strings that come again
    and again stay. Long strings are not kept.
    """

    def __init__(self, make, limit: int = TABLE_BYTES):
        self.make, self.limit, self.size = make, limit, 0
        self.young, self.old = {}, {}

    def values(self, keys: list) -> list:
        """The value of each of the keys, which should be distinct."""
        from sys import getsizeof
        young, old = self.young, self.old
        found = [young.get(k) or old.get(k) for k in keys]
        missing = [i for i, v in enumerate(found) if v is None]
        made = self.make([keys[i] for i in missing])
        for i, v in zip(missing, made):
            found[i] = v
        fresh = {k: v for k, v in zip(keys, found) if k not in young and len(k) <= LONGEST}
        self.size += _ENTRY * len(fresh) + sum(map(getsizeof, fresh)) + sum(map(getsizeof, fresh.values()))
        young.update(fresh)
        if self.size > self.limit // 2:
            self.young, self.old, self.size = {}, young, 0
        return found


class Lookup(dict):
    """Value of a string by ``make(string)``, kept by a worker up to about ``limit`` bytes; a full table starts anew."""

    def __init__(self, make, limit: int = TABLE_BYTES):
        super().__init__()
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, key: str):
        value = self.make(key)
        n = len(key)
        if n <= LONGEST:
            if self.size > self.limit:
                self.clear()
                self.size = 0
            self.size += n + 2 * _ENTRY  # the entry, its string and a number
            self[key] = value
        return value


def _word_hash(word: str) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)


def word_hashes() -> Lookup:
    """Hash of each word."""
    return kept_by("words", "hashes", lambda: Lookup(_word_hash))
