"""What a result service and its dashboard ask for, as functions of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U


def dashboard_rows(results: DataFrame) -> DataFrame:
    """Companies as a dashboard shows them: blanks filled, sites with a scheme, an id of name, site and place.

    The place is that of ``position``, from 0; rows without one get it by score, then ``ord`` or name and site.
    """
    from ..operators.rank import positions

    if "position" not in results.columns:
        ties = ["ord"] if "ord" in results.columns else ["company_name", "website"]
        results = positions(results.withColumn("__s", T.safe_score(F.col("score"))), [F.desc("__s"), *ties]).drop("__s")
    name, site = T.safe_text(F.col("company_name"), "Unknown"), T.safe_text(F.col("website"), "")
    full = F.when((site != "") & ~site.startswith("http"), F.concat(F.lit("https://"), site)).otherwise(site)
    label = F.concat_ws("-", T.safe_text(F.col("company_name"), "company"), T.safe_text(F.col("website"), "site"), F.col("position") - 1)
    df = results.withColumn("id", label)
    return df.withColumns({"company_name": name, "website": full, "score": T.safe_score(F.col("score"))})


def named_like(results: DataFrame, query: str | None, column: str = "company_name") -> DataFrame:
    """Rows whose name holds the query, without case; all of them for a blank one."""
    wanted = (query or "").strip().lower()
    return results.filter(F.lower(F.col(column)).contains(wanted)) if wanted else results


def summary(results: DataFrame, score: str = "score", name: str = "company_name", order: str | None = None) -> DataFrame:
    """One row: how many, the best row and the mean score (0 for none)."""
    key = F.struct(F.col(score), *([-F.col(order)] if order else []))
    return results.agg(F.count("*").alias("n"), F.max_by(name, key).alias("top_name"), F.max(score).alias("top_score"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("mean_score"))


def by_score(results: DataFrame) -> DataFrame:
    """Best first; ties keep their order."""
    return results.orderBy(F.desc("score"), "ord")


def top(results: DataFrame, n: int = 5) -> DataFrame:
    return by_score(results).limit(n)


def website_label(url: Column) -> Column:
    return U.domain(U.normalize(url))


@dataclass
class Service:
    """State of one result table: answers, refreshes and runs at most one refresh at a time."""

    load: object
    start: object
    seconds: int = 3600
    running: bool = False
    last_run: str | None = None
    log: list[str] = field(default_factory=list)

    def companies(self, modified: datetime | None, now: datetime) -> tuple[int, DataFrame | None]:
        """200 and rows, old ones too while a refresh begins; 202 while there are none; 500 on an error."""
        if modified is None:
            self.refresh(now)
            return 202, None
        if (now - modified).total_seconds() > self.seconds:
            self.refresh(now)
        try:
            rows = self.load()
            if rows.isEmpty():
                self.refresh(now)
                return 202, None
            return 200, rows
        except Exception as e:  # noqa: BLE001 - reported to the caller
            self.log.append(str(e))
            return 500, None

    def refresh(self, now: datetime) -> bool:
        """Begin a run unless one is under way."""
        if self.running:
            return False
        self.running, self.last_run = True, now.isoformat()
        self.start()
        return True

    def finished(self) -> None:
        self.running = False

    def status(self) -> dict:
        return {"running": self.running, "last_run": self.last_run}
