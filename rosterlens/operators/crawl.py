"""Crawls over tables of pages that were fetched before, and a sandbox source."""

from __future__ import annotations

import http.client
import math
import ssl
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U
from ..sources.folders import work_folder
from .html import page_parts, plain_links, scored_links

#: Text of a made-up site, for runs without a network; long enough to pass the gate on length.
SANDBOX = (
    "{name} designs machines that find their own way through yards, plants and fields. "
    "Engineers at {name} combine LiDAR, cameras and sensor fusion, and write the control code in ROS2 and PyTorch. "
    "The {name} Navigator system keeps a map by SLAM, plans paths and stops for people. "
    "Customers in warehouse automation, agriculture and defense run it on mobile robots and on drones. "
    "A second line, the {name} Inspector device, looks for cracks in pipes and turbine blades by computer vision. "
    "Both come with fleet management, object detection at the edge and reports for the people on shift. "
    "Services are installation, training of staff and yearly checks; spare parts are kept in three countries. "
    "Models are trained by deep learning on pictures that customers agree to share. "
    "Typical jobs are moving pallets overnight, counting stock, industrial inspection and autonomous navigation in mixed traffic. "
    "Write to sales@{domain} for a visit."
)


def sandbox_pages(roster: DataFrame, website: str = "website") -> DataFrame:
    """``roster`` with the page map of a made-up site for each website."""
    domain = F.coalesce(F.nullif(U.domain(U.normalize(F.col(website))), F.lit("")), F.lit("company.com"))
    name = F.initcap(F.replace(F.split(domain, r"\.")[0], F.lit("-"), F.lit(" ")))
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{name}"), name), F.lit("{domain}"), domain)
    return roster.withColumns({
        "all": fill(SANDBOX), "products": fill("{name} Navigator system, {name} Inspector device."),
        "services": F.lit("Installation, training and yearly checks."), "specifications": F.lit("LiDAR, stereo cameras, ROS2."), "quality": F.lit("GOOD"),
    })


def crawl(roster: DataFrame, pages: DataFrame, max_pages: int = 8, website: str = "website", **link_options) -> DataFrame:
    """(website, at, url, html) of the pages that a breadth-first crawl would visit.

    The queue starts at the website and takes at most twice ``max_pages`` addresses, of which
    the first ``max_pages`` are visited. Only the first two addresses add links, so two joins
    bring the whole queue. A page that isn't in the table still takes a place.
    """
    table = pages.select(U.normalize(F.col("url")).alias("url"), "html").filter("url <> ''")
    table = table.groupBy("url").agg(F.min("html").alias("html"))
    starts = roster.select(website).distinct().withColumn("url", U.normalize(F.col(website))).filter("url <> ''")
    found = starts.join(table, "url", "left").withColumn("queue", F.array("url"))

    def grow(rows: DataFrame) -> DataFrame:
        more = F.transform(scored_links(F.col("html"), F.col("url"), **link_options), lambda x: x["url"])
        queue = F.slice(F.array_distinct(F.concat("queue", F.coalesce(more, F.array().cast("array<string>")))), 1, 2 * max_pages)
        return rows.withColumn("queue", queue)

    first = grow(found).select(website, "queue", F.get("queue", F.lit(1)).alias("url"))
    queued = grow(first.join(table, "url", "left")).select(website, F.posexplode("queue").alias("at", "url")).filter(F.col("at") < max_pages)
    return queued.join(table, "url").select(website, "at", "url", "html")


def site_links(pages: DataFrame, keywords: tuple[str, ...] | None = None) -> DataFrame:
    """(url, k, to): relevant links of each page to its own site, by their place on the page; the pages' own addresses as they are."""
    options = () if keywords is None else (keywords,)
    links = pages.select("url", F.posexplode(plain_links(F.col("html"), F.col("url"))).alias("k", "to"))
    return links.filter((U.domain(F.col("to")) == U.domain(F.col("url"))) & U.relevant(F.col("to"), *options))


def crawl_depth(roster: DataFrame, pages: DataFrame, max_depth: int = 2, max_pages: int = 8, website: str = "website", keywords: tuple[str, ...] | None = None) -> DataFrame:
    """(website, at, depth, url, html): pages of one site within some links of its root, relevant ones only; ``at`` counts from 1.

    Pages come breadth first and in the order of the links to them, up to ``max_pages`` of a site. The links are cut out of the
    pages once and written; a recursive query follows them, never into a page of its own way, and no page is read again.
    Of the ways to a page the shortest counts, of equally long ones that whose links come first.
    """
    spark = roster.sparkSession
    table = pages.select(U.normalize(F.col("url")).alias("url"), "html").filter("url <> ''").groupBy("url").agg(F.min("html").alias("html"))
    path = work_folder(spark, "links")
    site_links(table, keywords).write.parquet(path)
    starts = roster.select(website).distinct().select(F.col(website).alias("site"), U.normalize(F.col(website)).alias("url")).filter("url <> ''")
    name = uuid.uuid4().hex
    spark.read.parquet(path).createOrReplaceTempView(f"links_{name}")
    starts.createOrReplaceTempView(f"starts_{name}")
    # The way lists places of links; a page is left by the links that lead to pages the way hasn't been to.
    limits = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(max_depth + 2)}
    old = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        ways = spark.sql(f"""
            WITH RECURSIVE walk(site, url, depth, way, seen) AS (
              SELECT site, url, 0, CAST(array() AS array<int>), array(url) FROM starts_{name}
              UNION ALL
              SELECT w.site, l.to, w.depth + 1, concat(w.way, array(l.k)), concat(w.seen, array(l.to))
              FROM walk w JOIN links_{name} l ON l.url = w.url
              WHERE w.depth < {int(max_depth)} AND NOT array_contains(w.seen, l.to))
            SELECT site, url, min(struct(depth, way)) AS at FROM walk GROUP BY site, url""")
        found = work_folder(spark, "ways")
        ways.write.parquet(found)  # while the limits hold
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.catalog.dropTempView(f"links_{name}")
        spark.catalog.dropTempView(f"starts_{name}")
    # Of a site with many pages each task passes on its first ones alone.
    visited = spark.read.parquet(found).join(table.select("url"), "url", "left_semi")
    first = visited.withColumn("__r", F.row_number().over(Window.partitionBy("site").orderBy("at"))).filter(F.col("__r") <= max_pages)
    return first.join(table, "url").select(F.col("site").alias(website), F.col("__r").alias("at"), F.col("at.depth").alias("depth"), "url", "html")


def page_map(visited: DataFrame, website: str = "website", most: int = 4000) -> DataFrame:
    """(website, all, products, services, specifications, quality) merged over a site's visited pages (8 at most)."""
    from ..functions.text import quality_flag

    parts = page_parts(visited)
    joined = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(f"parts.{c}").alias("t")))), lambda x: x["t"]), lambda t: t != ""), " ")
    out = parts.groupBy(website).agg(joined("main").alias("all"), *(joined(c).alias(c) for c in ("products", "services", "specifications")))
    out = out.withColumns({c: F.substring(c, 1, most) for c in ("all", "products", "services", "specifications")})
    return out.withColumn("quality", quality_flag(F.col("all")))


#: What requests say of themselves: plainly at first, then as a browser does.
PLAIN = {"User-Agent": "Mozilla/5.0"}
AS_BROWSER = PLAIN | {"Accept": "text/html,application/xhtml+xml,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9", "Upgrade-Insecure-Requests": "1"}
#: Answers after which another try is of no use.
FINAL = (401, 404, 410)


class Session:
    """Open connections, cookies and the time of the last request of each host; for one task."""

    def __init__(self, timeout: float, verify: bool = True, pace: float = 0.0, redirects: int = 5):
        self.timeout, self.pace, self.redirects = timeout, pace, redirects
        self.open: dict[tuple[str, str], http.client.HTTPConnection] = {}
        self.cookies: dict[str, dict[str, str]] = {}
        self.last: dict[str, float] = {}
        self.context = ssl.create_default_context()
        if not verify:
            self.context.check_hostname, self.context.verify_mode = False, ssl.CERT_NONE

    def get(self, url: str, headers: dict[str, str]) -> tuple[int, str]:
        """Status and text of the answer, redirects followed. Raises where there is no answer."""
        for _ in range(self.redirects + 1):
            status, place, body = self._ask(url, headers)
            if status not in (301, 302, 303, 307, 308) or not place:
                return status, body.decode("utf-8", "replace")
            url = urljoin(url, place)
        raise ValueError("too many redirects")

    def _ask(self, url: str, headers: dict[str, str]) -> tuple[int, str | None, bytes]:
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError("not an address of a page")
        host = parts.netloc.rpartition("@")[2]
        wait = self.last.get(host, -math.inf) + self.pace - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        key = (parts.scheme, host)
        kept = key in self.open
        if not kept:
            self.open[key] = http.client.HTTPSConnection(host, timeout=self.timeout, context=self.context) if parts.scheme == "https" else http.client.HTTPConnection(host, timeout=self.timeout)
        cookies = self.cookies.setdefault(host, {})
        sent = headers | {"Connection": "keep-alive"} | ({"Cookie": "; ".join(f"{k}={v}" for k, v in cookies.items())} if cookies else {})
        target = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._") + (f"?{quote(parts.query, safe='/?%:@!$&()*+,;=~-._')}" if parts.query else "")
        try:
            self.last[host] = time.monotonic()
            self.open[key].request("GET", target, headers=sent)
            r = self.open[key].getresponse()
            body = r.read()
        except (http.client.HTTPException, OSError) as e:
            self.open.pop(key).close()
            if kept and not isinstance(e, TimeoutError):
                return self._ask(url, headers)  # a connection that the host has closed since
            raise
        for line in r.headers.get_all("Set-Cookie") or ():
            name, _, value = line.split(";")[0].partition("=")
            cookies[name.strip()] = value.strip()
        if r.will_close:
            self.open.pop(key).close()
        return r.status, r.headers.get("Location"), body

    def page(self, url: str, attempts: int, headers: tuple[dict, ...], least: int, backoff: float) -> tuple[str | None, str | None]:
        """Text, or the reason why there is none."""
        error = None
        for i in range(attempts):
            try:
                status, text = self.get(url, headers[min(i, len(headers) - 1)])
                if status == 200:
                    return (text, None) if len(text) > least else (None, "too short")
                error = f"status {status}"
                if status in FINAL:
                    break
            except Exception as e:  # noqa: BLE001 - a row's failure is its value
                error = (str(e) or type(e).__name__)[:200]
            if i < attempts - 1:
                time.sleep(backoff * 2**i)
        return None, error

    def close(self) -> None:
        for c in self.open.values():
            c.close()


def fetch(
    urls: DataFrame, url_col: str = "url", timeout: float = 10.0, attempts: int = 3, headers: tuple[dict, ...] = (PLAIN, AS_BROWSER), verify: bool = True, least: int = 100,
    pace: float = 0.5, backoff: float = 1.0, lanes: int = 1,
) -> DataFrame:
    """(url, html, error): distinct pages over the network. Each row carries its own error; nothing is raised.

    Addresses are dealt by host, so that one task asks a host, over one connection with its cookies and with ``pace`` seconds between
    two requests. ``lanes`` deals each host to so many tasks, for hosts that allow it; a host of a third of all pages takes its time
    otherwise, by intent. The first try goes with the first headers, later ones with the next, after a pause that doubles;
    some statuses are final, and a page of ``least`` characters or fewer counts as empty. With one attempt this is a plain, polite get.
    """
    spark = urls.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    lane = F.pmod(F.xxhash64(url_col), F.lit(lanes))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = Session(timeout, verify, pace)
        try:
            for b in batches:
                for url in b.column(0).to_pylist():
                    html, error = (None, "no address") if not url else session.page(url, attempts, headers, least, backoff)
                    yield pa.RecordBatch.from_arrays([pa.array([url], pa.string()), pa.array([html], pa.string()), pa.array([error], pa.string())], ["url", "html", "error"])
        finally:
            session.close()

    dealt = urls.select(F.col(url_col).cast("string").alias("url")).distinct().withColumns({"host": host, "lane": lane})
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "host", "lane").sortWithinPartitions("host", "url")
    return dealt.select("url").mapInArrow(get, "url string, html string, error string")
