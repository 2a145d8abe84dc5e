"""Operators of the job service over tables of events: rate limits, client addresses, job states, queues."""

from __future__ import annotations

from functools import reduce
from ipaddress import ip_network

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from orrery.functions.text import let, strip

WINDOW_S, LIMIT, TTL_S, TIMEOUT_S = 60, 10, 900, 90


def epoch(ts: Column) -> Column:
    """Microseconds since 1970; times without zone count as UTC of the session."""
    return F.unix_micros(ts.cast("timestamp"))


def fixed_window(requests: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_S) -> DataFrame:
    """requests(event_id, ts, key) -> with bucket, n (its place in its key's bucket) and admitted."""
    bucket = F.floor(epoch(F.col("ts")) / (seconds * 1_000_000))
    w = Window.partitionBy("key", "bucket").orderBy("ts", "event_id")
    return requests.withColumn("bucket", bucket).withColumn("n", F.row_number().over(w)).withColumn("admitted", F.col("n") <= limit)


def sliding_log(requests: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_S) -> DataFrame:
    """M2: requests(event_id, ts, key) -> with admitted: a request is admitted if fewer than `limit` admitted ones lie within `seconds` before it. Each decision depends on those before it, so
    the rows of a key pass in order, in batches: memory holds the last `limit` admitted times, however many requests a key has."""
    from collections import deque
    from collections.abc import Iterator

    own = requests.withColumn("_t", epoch(F.col("ts")))
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = object(), deque()
        for pdf in batches:
            admitted = []
            for k, t in zip(pdf["key"], pdf["_t"], strict=True):
                if k != key:
                    key, log = k, deque()
                while log and log[0] < t - seconds * 1_000_000:
                    log.popleft()
                admitted.append(len(log) < limit)
                if admitted[-1]:
                    log.append(t)
            yield pdf.drop(columns="_t").assign(admitted=pd.array(admitted, dtype="bool"))

    # times without zone lose nothing on their way through pandas
    return own.repartition(n, "key").sortWithinPartitions("key", "_t", "event_id").mapInPandas(run, StructType([*requests.schema, StructField("admitted", BooleanType())]))


def scope_key(scope: Column, api_key: Column, ip: Column) -> Column:
    """M3: the API key if that is the scope and one is given, else the address, else unknown."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.when(scope == "api_key", F.coalesce(given(api_key), given(ip), F.lit("unknown"))).otherwise(F.coalesce(given(ip), F.lit("unknown")))


def ipv4(c: Column) -> Column:
    """An IPv4 address as a number, null for anything else. Octets have no leading zeros."""
    p = F.split(c, r"\.")
    octet = lambda i: F.get(p, F.lit(i)).try_cast("long")
    fine = F.rlike(c, F.lit(r"\A((0|[1-9][0-9]{0,2})\.){3}(0|[1-9][0-9]{0,2})\z"))
    for i in range(4):
        fine = fine & (octet(i) <= 255)
    return F.when(fine, ((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3))


def ipv6(c: Column) -> Column:
    """An IPv6 address, without its scope, as an array of 8 numbers, null for anything else. The last two may be written as an IPv4 address; `::` stands for one group of zeros or more."""
    tail = F.regexp_extract(c, r"(?s)^.*:([^:]*\.[^:]*)$", 1)
    last = ipv4(tail)
    hexes = F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(tail)), F.hex(F.shiftright(last, 16)), F.lit(":"), F.hex(last.bitwiseAND(F.lit(0xFFFF).cast("long"))))

    def groups(text: Column) -> Column:
        halves = F.split(text, "::", -1)
        side = lambda i: F.when(F.coalesce(F.get(halves, F.lit(i)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, F.lit(i)), ":", -1))
        n = F.size(side(0)) + F.size(side(1))
        short = F.size(halves) == 2
        fine = F.forall(F.concat(side(0), side(1)), lambda g: F.rlike(g, F.lit(r"\A[0-9A-Fa-f]{1,4}\z"))) & F.when(short, n <= 7).otherwise((F.size(halves) == 1) & (n == 8))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n))
        whole = F.when(short, F.concat(side(0), zeros, side(1))).otherwise(side(0))
        return F.when(fine, F.transform(whole, lambda g: F.conv(g, 16, 10).cast("int")))

    return let(F.when(tail == "", c).when(last.isNotNull(), hexes), groups)


def ipv6_text(groups: Column) -> Column:
    """The canonical text of 8 numbers: lower case, no leading zeros, the first of the longest runs of two zeros or more as `::`; addresses that hold an IPv4 one (::ffff:0:0/96) end in its text."""

    def run(i: int) -> Column:
        length = F.lit(0)
        for j in range(7, i - 1, -1):
            length = F.when(F.get(groups, F.lit(j)) == 0, length + 1).otherwise(F.lit(0))
        return length

    def text(best: Column) -> Column:
        name = lambda g: F.lower(F.hex(g.cast("long")))
        part = lambda x: F.array_join(F.transform(x, name), ":")
        n, i = best["n"], 8 - best["left"]
        return F.when(n < 2, part(groups)).otherwise(F.concat(part(F.slice(groups, F.lit(1), i)), F.lit("::"), part(F.slice(groups, i + n + 1, F.greatest(F.lit(0), 8 - i - n)))))

    best = F.array_max(F.array(*[F.struct(run(i).alias("n"), F.lit(8 - i).alias("left")) for i in range(8)]))
    mapped = F.forall(F.slice(groups, 1, 5), lambda g: g == 0) & (F.get(groups, F.lit(5)) == 0xFFFF)
    octets = [F.get(groups, F.lit(i)) for i in (6, 7)]
    dotted = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[x.cast("string") for o in octets for x in (F.shiftright(o, 8), o.bitwiseAND(F.lit(255)))]))
    return F.when(mapped, dotted).otherwise(let(best, text))


def address(c: Column) -> Column:
    """M4: an address in its canonical form, so that one client has one spelling; null for what is none. An IPv6 scope stays."""
    c = strip(c)
    cut = F.instr(c, F.lit("%"))
    bare, scope = F.when(cut > 0, F.substring(c, F.lit(1), cut - 1)).otherwise(c), F.when(cut > 0, F.substring(c, cut, F.length(c))).otherwise("")
    six = let(ipv6(bare), lambda g: F.when(g.isNotNull(), F.concat(ipv6_text(g), scope)))
    return F.when(ipv4(c).isNotNull(), c).when(F.contains(c, F.lit(":")) & ((cut == 0) | (F.length(scope) > 1) & (F.instr(F.substring(scope, 2, 100), F.lit("%")) == 0)), six)


def in_network(host: Column, network: str) -> Column:
    """Whether an address lies in a network, of IPv4 or IPv6, a.b.c.d/n or a single address; false where either is none."""
    try:
        net = ip_network(network, strict=False)
    except ValueError:
        return F.lit(False)
    low, high = int(net.network_address), int(net.broadcast_address)
    if net.version == 4:
        return F.coalesce(ipv4(host).between(low, high), F.lit(False))
    part = lambda x, i: (x >> (112 - 16 * i)) & 0xFFFF
    bare = F.split_part(host, F.lit("%"), F.lit(1))
    # a network's addresses are those whose groups each lie between its first's and its last's
    return F.coalesce(let(ipv6(bare), lambda g: reduce(Column.__and__, [F.get(g, F.lit(i)).between(part(low, i), part(high, i)) for i in range(8)])), F.lit(False))


def client_ip(host: Column, forwarded: Column, real: Column, trust: bool = True, proxies: list[str] | None = None) -> Column:
    """M4: the first valid address of X-Forwarded-For, then of X-Real-IP, in canonical form, where the peer's headers are trusted (there is a peer, and it is in one of the networks, or there is no list); else the
    peer as it is. Entries of the list that are no networks are passed over."""
    if not trust:
        return host
    trusted = F.lit(True) if not proxies else reduce(Column.__or__, [in_network(host, p) for p in proxies])
    trusted = F.coalesce(host, F.lit("")).__ne__("") & trusted
    first = lambda c: F.get(F.array_compact(F.transform(F.split(F.coalesce(c, F.lit("")), ","), address)), F.lit(0))
    return F.when(trusted, F.coalesce(first(forwarded), first(real), host)).otherwise(host)


def job_states(events: DataFrame, now: Column | None = None, ttl: int = TTL_S) -> DataFrame:
    """M5: events(job_id, ts, status, event_id, ...) -> one row a job: its latest status, `expired` if its last write is longer ago than the time to live, first and last time, number of events. `now` defaults
    to the latest event of all."""
    last = events.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("l"), F.min("ts").alias("created_at"), F.count("*").alias("n_events"))
    if now is None:
        last = last.crossJoin(events.agg(F.max("ts").alias("_now")))  # one row
        now = F.col("_now")
    old = epoch(F.col("l.ts")) < epoch(now) - ttl * 1_000_000
    return last.select("job_id", F.when(old, "expired").otherwise(F.col("l.status")).alias("status"), "created_at", F.col("l.ts").alias("updated_at"), "n_events")


def queue_order(jobs: DataFrame, lifo: bool = False, by: str = "queue") -> DataFrame:
    """M6: jobs(queue, ts, job_id) -> with place, the order of delivery: first in, first out, or as a list pushed and popped at one end (Q12)."""
    c = [F.col("ts").desc(), F.col("job_id").desc()] if lifo else [F.col("ts"), F.col("job_id")]
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*c)))


def outcomes(runs: DataFrame, timeout: float = TIMEOUT_S) -> DataFrame:
    """M7: runs(job_id, duration_s, error) -> with status and error: a run beyond the timeout failed."""
    late = F.col("duration_s") > timeout
    return runs.withColumns({
        "status": F.when(late | F.col("error").isNotNull(), "failed").otherwise("succeeded"),
        "error": F.when(late, "Analysis timed out.").otherwise(F.col("error")),
    })


def within_limits(kind: Column, body: Column, text: Column, image: Column, max_body: int = 8_000_000, max_text: int = 200_000, max_image: int = 4_000_000) -> Column:
    """Null if a request fits, else what it exceeds."""
    return F.when(F.octet_length(body) > max_body, "body too large").when((kind == "text") & (F.length(text) > max_text), "text too long").when((kind == "image") & (F.octet_length(image) > max_image), "image too large")
