"""The few places where the text of an expression differs between Spark SQL and DuckDB."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    sha: str
    instant: str
    day: str

    def sha256(self, text: str) -> str:
        return self.sha.format(text)

    def instant_text(self, ts: str) -> str:
        return self.instant.format(ts)

    def to_date(self, ts: str) -> str:
        return self.day.format(ts)


SPARK = Dialect("sha2({0}, 256)", "date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "cast({0} as date)")
DUCK = Dialect("sha256({0})", "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')", "cast({0} as date)")
