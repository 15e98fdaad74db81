"""Users' own readers of reports: registered by a decorator or loaded from files and modules, tried by priority.

A reader that fails on a text, or a file that can't be loaded, costs its own rows alone. Readers run in tasks, on batches
of texts; Spark carries them there, so a reader needs nothing that can't be pickled.
"""

from __future__ import annotations

import importlib
import importlib.util
import logging
import sys
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.merging import replace_or_supplement

MODES = ("replace", "supplement")
log = logging.getLogger(__name__)


class Row(NamedTuple):
    name: str
    value: str
    unit: str = ""
    reference_range: str = ""
    status: str = ""
    section: str = ""


class Reader:
    """Derive from it, with a ``name``; a replacing reader's rows take the place of the grammars' and of lower ones'."""

    name = ""
    priority = 0
    mode = "replace"

    def matches(self, text: str) -> bool:
        raise NotImplementedError

    def parse(self, text: str) -> Iterable[Row]:
        raise NotImplementedError


class Registry:
    """The readers of a session."""

    def __init__(self):
        self.classes: list[type[Reader]] = []

    def register(self, cls: type[Reader]) -> type[Reader]:
        """A class decorator; ValueError without a name or with another mode, TypeError for what is no reader."""
        if not (isinstance(cls, type) and issubclass(cls, Reader)):
            raise TypeError(f"{cls!r} is no reader")
        if not cls.name or cls.mode not in MODES:
            raise ValueError(f"{cls.__name__} needs a name, and a mode of {MODES}")
        if cls not in self.classes:
            self.classes.append(cls)
        return cls

    def load(self, folder: str | None = None, modules: Iterable[str] = ()) -> list[str]:
        """Import the files of a folder (none that begins with ``_``) and modules, and register the readers that they define.

        Gives the names of those that couldn't be loaded; the others go on.
        """
        found, failed = [], []
        for path in sorted(Path(folder).glob("*.py")) if folder else []:
            if not path.name.startswith("_"):
                found.append((str(path), lambda p=path: self._of_file(p)))
        found += [(m, lambda m=m: importlib.import_module(m)) for m in modules]
        for name, load in found:
            try:
                module = load()
                for cls in list(vars(module).values()):
                    if isinstance(cls, type) and issubclass(cls, Reader) and cls.__module__ == module.__name__ and cls.name:
                        self.register(cls)
            except Exception:  # noqa: BLE001  a user's file
                log.exception("could not load %s", name)
                failed.append(name)
        return failed

    @staticmethod
    def _of_file(path: Path):
        spec = importlib.util.spec_from_file_location(f"tarnwork_reader_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        # Executors don't have the file: its classes are carried by value.
        sys.modules[module.__name__] = module
        cloudpickle.register_pickle_by_value(module)
        return module

    def readers(self) -> list[Reader]:
        """One of each name (the one registered first), the highest priority first, then as registered."""
        first: dict[str, type[Reader]] = {}
        for cls in self.classes:
            first.setdefault(cls.name, cls)
        return [cls() for cls in sorted(first.values(), key=lambda c: -c.priority)]


def read_rows(docs: DataFrame, readers: list[Reader], *, id: str, text: str) -> DataFrame:  # noqa: A002
    """``id, reader, priority, mode, place, no`` and the fields of ``Row`` from each reader that matches a text; null texts are empty.

    ``place`` is the reader's in the order of ``readers``. One that fails gives nothing for that text.
    """
    fields = Row._fields

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, content in zip(batch[id], batch[text], strict=True):
                for place, r in enumerate(readers):
                    try:
                        rows = [Row(*row) for row in r.parse(content) or []] if r.matches(content) else []
                    except Exception:  # noqa: BLE001  a user's reader
                        rows = []
                    out += [(key, r.name, r.priority, r.mode, place, no, *row) for no, row in enumerate(rows)]
            yield pd.DataFrame(out, columns=[id, "reader", "priority", "mode", "place", "no", *fields])

    schema = f"`{id}` {dict(docs.dtypes)[id]}, reader string, priority int, mode string, place int, no int, " + ", ".join(f"{f} string" for f in fields)
    return docs.select(id, F.coalesce(text, F.lit("")).alias(text)).mapInPandas(read, schema)


def combined_rows(base: DataFrame, docs: DataFrame, readers: list[Reader], *, id: str, text: str) -> DataFrame:  # noqa: A002
    """``base(id, no, {fields of Row})`` with the rows of the readers: of the replacing ones that found something the first, then the supplements.

    A supplement's row of a name, section and value that are there already isn't added. ``reader`` is null for rows of ``base``.
    """
    found = read_rows(docs, readers, id=id, text=text).withColumn("priority", -F.col("place")).drop("place")
    rows = base.select(id, F.lit(None).cast("string").alias("reader"), "no", *Row._fields)
    keyed = lambda frame: frame.withColumns({"_name": F.lower(F.trim("name")), "_value": F.trim("value")})
    return replace_or_supplement(keyed(rows), keyed(found), keys=[id, "_name", "section", "_value"], group=[id], order=["no"]).drop("_name", "_value", "priority")
