"""Structured Streaming jobs over the logs: reviews, requests, arriving notes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirefold import fixed_values as fv
from quirefold.operators import deid
from quirefold.operators.chunking import note_paragraphs
from quirefold.operators.study import DAY_US, rating_code
from quirefold.session import shared_dir

CARD = "card_id long, n_reviews long, n_rejected long, reps int, interval_days int, ease double, last_reviewed_us long, next_review_us long"
CARD_STATE = "ease double, interval_days int, reps int, n long, rejected long, last long"


def _next(state: tuple[float, int, int], code: str) -> tuple[float, int, int]:
    """The rating rule for one review, as in the batch fold."""
    ease, days, reps = state
    if code == "-":
        return state
    if code == "0":
        return max(fv.MIN_EASE, ease - 0.2), 1, 0
    reps += 1
    if code == "1":
        return max(fv.MIN_EASE, ease - 0.15), max(1, int(days * 1.2)), reps
    if reps <= 2:
        days = {("2", 1): 1, ("2", 2): 6, ("3", 1): 3, ("3", 2): 10}[code, reps]
    else:
        days = max(1, int(days * ease if code == "2" else days * ease * 1.3))
    return ease + (0.15 if code == "3" else 0.0), days, reps


def sm2_stream(reviews: DataFrame) -> DataFrame:
    """Card state kept across micro-batches; emits a card's state whenever it is reviewed.

    Reviews of one micro-batch are put in time order per card; batches must arrive in order.
    The source's ``maxFilesPerTrigger`` bounds what a batch holds for one card. As in the batch
    fold, a review whose next date cannot be held is counted as rejected and changes nothing else.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ease, days, reps, n, rejected, last = state.get if state.exists else (fv.START_EASE, 1, 0, 0, 0, 0)
        log = pd.concat(list(batches)).sort_values(["us", "review_id"])
        for us, code in zip(log["us"].tolist(), log["code"]):
            rated = _next((ease, days, reps), code)
            if us + rated[1] * DAY_US <= fv.LAST_DATE_US:
                (ease, days, reps), last = rated, us
            else:
                rejected += 1
        n += len(log)
        state.update((float(ease), int(days), int(reps), int(n), int(rejected), int(last)))
        seen = n > rejected
        yield pd.DataFrame(
            {
                "card_id": [key[0]], "n_reviews": [n], "n_rejected": [rejected], "reps": [reps], "interval_days": [days], "ease": [float(ease)],
                "last_reviewed_us": pd.array([last if seen else None], dtype="Int64"),
                "next_review_us": pd.array([last + days * DAY_US if seen else None], dtype="Int64"),
            }
        )

    slim = reviews.select("card_id", "us", "review_id", rating_code(F.col("rating")).alias("code"))
    return slim.groupBy("card_id").applyInPandasWithState(update, CARD, CARD_STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, sink, checkpoint: str, batches: int | None = None) -> None:
    """Drain what is there and stop; ``sink(batch, batch_id)`` must be idempotent per batch.

    With ``batches`` the query is stopped once so many micro-batches of this run are done; a later run goes on from the checkpoint.
    """
    done = []

    def counted(batch: DataFrame, batch_id: int) -> None:
        if batches is None or len(done) < batches:
            sink(batch, batch_id)
            done.append(batch_id)
        else:
            raise _Enough

    q = stream.writeStream.outputMode(mode).foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except StreamingQueryException:
        if batches is None or len(done) < batches:
            raise


class _Enough(Exception):
    pass


def batch_writer(path: str):
    """Each micro-batch overwrites its own folder, so a replayed batch leaves no duplicates."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest_cards(spark: SparkSession, path: str) -> DataFrame:
    """The last emitted state of every card."""
    rows = spark.read.parquet(path)
    row = F.struct(*[c for c in rows.columns if c not in ("card_id", "batch_id")])
    return rows.groupBy("card_id").agg(F.max_by(row, "batch_id").alias("r")).select("card_id", "r.*")


def rate_stream(requests: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    """Requests per user, scope and window; rows later than the watermark are dropped.

    ``requests``: ts, user, scope. A window is counted map-side first, so a busy user sends
    partial counts and not requests.
    """
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = requests.withWatermark("ts", late).groupBy(w.alias("w"), "user", "scope").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user", "scope", F.col("w.start").alias("window_start"), "n")


ADMITTED = "request_id long, user long, scope string, us long, max_requests int, admitted boolean"


THROTTLE_KEYS = 2048


class _Throttle(StatefulProcessor):
    """For the keys (user, scope) of one bucket the times of the accepted requests that still count, as many as the limit at most for each.

    A bucket's state is read and written once in a micro-batch; a list, a timer and a frame for each key would cost a call to the engine each.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [("user", T.LongType()), ("no_user", T.BooleanType()), ("scope", T.StringType()), ("us", T.LongType()), ("span", T.LongType())]
        self.accepted = handle.getListState("accepted", T.StructType([T.StructField(n, t) for n, t in fields]))
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values(["us", "no_id", "request_id"])
        now = timerValues.getCurrentWatermarkInMs()
        held: dict[tuple, list] = {}
        for user, no_user, scope, t, span in self.accepted.get() if self.accepted.exists() else []:
            if (t + span) // 1000 + 1 > now:  # the others count for no row that is still on time
                held.setdefault((user, no_user, scope), []).append((t, span))
        said = []
        for user, no_user, scope, us, most, span in zip(*(log[c].tolist() for c in ("user", "no_user", "scope", "us", "max_requests", "span")), strict=True):
            mine = [h for h in held.get((user, no_user, scope), ()) if h[0] > us - span]
            said.append(len(mine) < most)
            if said[-1]:
                mine.append((us, span))
            held[user, no_user, scope] = mine
        left = [(*k, t, span) for k, mine in held.items() for t, span in mine]
        if left:
            self.accepted.put(left)
        else:
            self.accepted.clear()
        # a bucket is forgotten once its last accepted request no longer counts
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if left:
            expiry = max(max(t + span for *_, t, span in left) // 1000 + 1, now + 1)
            self.handle.registerTimer(expiry)
            self.timer.update((expiry,))
        out = log[["request_id", "user", "scope", "us", "max_requests"]].assign(admitted=said)
        for name, absent in (("request_id", "no_id"), ("user", "no_user")):
            out[name] = out[name].astype("Int64").mask(log[absent])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        self.timer.clear()
        return iter([])

    def close(self) -> None:
        pass


def admitted_stream(requests: DataFrame, limits: DataFrame, late: str = "5 minutes", buckets: int = THROTTLE_KEYS) -> DataFrame:
    """Whether each request is let through when only requests that were let through count.

    ``requests``: request_id, user, scope, us, ts (event time); ``limits``: scope, max_requests, seconds, broadcast as they are one row per
    scope. A request passes if fewer than ``max_requests`` accepted ones lie in the ``seconds`` before it; requests of one micro-batch are taken
    in order of time and id. State is one short list of times per user and scope, kept together for the keys of one of ``buckets`` hash
    buckets, left out when it counts no more and dropped by a timer; a checkpoint holds for the number of buckets it was made with. Batches must
    arrive in order up to ``late``; the operator leaves out rows later than that, which :func:`admission_sink` tells apart beforehand.
    The session needs the RocksDB state store (``state_store``).
    """
    sized = requests.join(F.broadcast(limits), "scope").withColumn("span", F.col("seconds").cast("long") * 1_000_000)
    bucket = F.pmod(F.xxhash64("user", "scope"), F.lit(buckets)).alias("bucket")
    ids = [c for name, absent in (("request_id", "no_id"), ("user", "no_user")) for c in (F.coalesce(name, F.lit(0)).cast("long").alias(name), F.col(name).isNull().alias(absent))]
    rows = sized.select(bucket, *ids, "scope", "us", "ts", "max_requests", "span").withWatermark("ts", late)
    return rows.groupBy("bucket").transformWithStateInPandas(_Throttle(), ADMITTED, "Append", "eventTime")


def state_store(spark: SparkSession) -> None:
    """Use RocksDB for the state of the session's streams, which list state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def admission_sink(path: str, late_us: int):
    """Per micro-batch: requests later than ``late_us`` behind the newest of all earlier batches go to a table of their own.

    Returns a splitter for the raw batches: on-time rows are written to ``path``/ontime, the others to ``path``/late, each batch in a folder of its
    own, which a replay overwrites. The newest time so far is read back from the folders of earlier batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = None
        if batch_id:
            before = spark.read.parquet(f"{path}/newest").where(F.col("batch_id") < batch_id)
            newest = before.agg(F.max("us")).first()[0]
        bound = F.lit(newest - late_us if newest is not None else None).cast("long")
        late = F.coalesce(F.col("us") < bound, F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/ontime/batch_id={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        batch.agg(F.max("us").alias("us")).write.mode("overwrite").parquet(f"{path}/newest/batch_id={batch_id}")

    return write


def note_sink(root: str, mapping_root: str, delimiter: str = "\n\n"):
    """Per micro-batch: mask notes, check them, and write masked text, mapping and paragraphs.

    ``mapping_root`` is a folder of its own, with stricter access, for the mapping that restores
    the originals; the staged rows hold it too and go there as well.

    A note that leaks or already holds placeholders goes to quarantine without its text.
    Each table gets the batch's own folder, overwritten on replay.
    """

    if mapping_root.rstrip("/") == root.rstrip("/"):
        raise ValueError("the mapping needs a folder apart from the masked text")

    def write(batch: DataFrame, batch_id: int) -> None:
        stage = f"{mapping_root}/stage/batch_id={batch_id}"
        done = deid.deidentify(batch)
        reasons = deid.leak_reasons(F.col("masked_text"), F.map_keys("tags"))
        done.select("doc_id", "masked_text", "tags", "pii_entity_count", "quarantined", reasons.alias("reasons")).write.mode(
            "overwrite"
        ).parquet(stage)
        staged = batch.sparkSession.read.parquet(stage)
        bad = F.col("quarantined") | (F.size("reasons") > 0)
        good = staged.filter(~bad)
        tables = {
            "masked": good.select("doc_id", "masked_text", "pii_entity_count"),
            "mapping": deid.mapping_table(good),
            "paragraphs": note_paragraphs(good.select("doc_id", F.col("masked_text").alias("text")), delimiter),
            "quarantine": staged.filter(bad).select("doc_id", "reasons", "quarantined"),
        }
        for name, df in tables.items():
            base = mapping_root if name == "mapping" else root
            df.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")

    return write


def staged_files(df: DataFrame, n_files: int) -> str:
    """A table rewritten as several files in the shared folder, to be read as a stream."""
    path = shared_dir(df.sparkSession)
    df.repartition(n_files).write.mode("overwrite").parquet(path)
    return path


def staged_in_order(df: DataFrame, order: str, n_slices: int, key: str, n_files: int = 2) -> tuple[str, int]:
    """The same with consecutive ranges of ``order`` written one after the other; the folder and a range's length.

    A key is in one file of a range, so its rows arrive in order however files fall into batches,
    and no row is later than one range.
    """
    path = shared_dir(df.sparkSession)
    lo, hi = df.agg(F.coalesce(F.min(order), F.lit(0)), F.coalesce(F.max(order), F.lit(0))).first()
    step = (hi - lo) // n_slices + 1
    for i in range(n_slices):
        part = df.filter((F.col(order) >= lo + i * step) & (F.col(order) < lo + (i + 1) * step))
        part.repartition(n_files, key).write.mode("append").parquet(path)
    return path, step
