"""Date sources that a project adds itself, as SQL functions: usable in queries and in date_for()."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Sources that the library has; a plug-in can't take their place.
BUILT_IN = ("camera", "filename", "album", "upload")
#: What a plug-in's body can use; all are text.
PARAMETERS = ("filename", "capture_time", "uploaded", "album_name")
#: Types that a body may have; dates and times become ISO text.
TYPES = ("string", "date", "timestamp", "timestamp_ntz")


class PluginError(ValueError):
    """A plug-in that can't be used, and why."""


class DatePlugins:
    """Plug-ins of a session by name. Each is a temporary SQL function of PARAMETERS that gives ISO text or null."""

    def __init__(self, spark: SparkSession):
        self.spark, self.refused = spark, {}
        self._names: list[str] = []

    def register(self, name: str, body: str) -> None:
        """Make a SQL expression over PARAMETERS a date source; PluginError if its name, body or type won't do."""
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise PluginError(f"{name!r} is no plain lower-case name")
        if name in BUILT_IN or name in PARAMETERS:
            raise PluginError(f"{name!r} is a source that the library has")
        if name not in self._names and self.spark.catalog.functionExists(name):
            raise PluginError(f"{name!r} is a function already")
        given = ", ".join(f"CAST(NULL AS STRING) AS {p}" for p in PARAMETERS)
        try:
            kind = self.spark.sql(f"SELECT ({body}) AS value FROM (SELECT {given})").schema["value"].dataType.simpleString()
            if kind not in TYPES:
                raise PluginError(f"{name!r} gives {kind}, not text or a date")
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} STRING' for p in PARAMETERS)}) RETURNS STRING RETURN CAST(({body}) AS STRING)")
        except (AnalysisException, ParseException) as error:
            raise PluginError(f"{name!r} can't be analysed: {str(error)[:200]}") from error
        self._names.append(name)

    def register_all(self, bodies: dict[str, str]) -> None:
        """Register what can be; why the others can't is in `refused`, and doesn't keep the rest from working."""
        for name, body in bodies.items():
            try:
                self.register(name, body)
            except PluginError as error:
                self.refused[name] = str(error)

    def sources(self) -> dict[str, Callable[[dict[str, Column]], Column]]:
        """What date_for() takes as plugins; columns that a caller lacks are null."""
        none = F.lit(None).cast("string")
        call = lambda name: lambda columns: F.call_function(name, *[columns.get(p, none).cast("string") for p in PARAMETERS])
        return {name: call(name) for name in self._names}
