import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quirefold.operators import governance as gov
from quirefold.operators import study as st
from quirefold.session import shared_dir
from quirefold.streaming import jobs

REVIEW = "card_id long, us long, review_id long, rating string"


def replay(log):
    """(us, rating) pairs; a review whose next date lies after the year 9999 changes nothing."""
    ease, days, reps = 2.5, 1, 0
    for us, r in log:
        if r == "again":
            new = max(1.3, ease - 0.2), 1, 0
        elif r == "hard":
            new = max(1.3, ease - 0.15), max(1, int(days * 1.2)), reps + 1
        elif r == "good":
            new = ease, 1 if reps == 0 else 6 if reps == 1 else int(days * ease), reps + 1
        else:
            new = ease + 0.15, 3 if reps == 0 else 10 if reps == 1 else int(days * ease * 1.3), reps + 1
        try:
            datetime(1970, 1, 1) + timedelta(microseconds=us) + timedelta(days=new[1])
        except OverflowError:
            continue
        ease, days, reps = new
    return reps, days, ease


def test_sm2_sequence(spark):
    for ratings, want in [(["good", "good", "easy"], (3, 19, 2.65)), (["good", "good", "easy", "again"], (0, 1, 2.45)), (["odd", "Good "], (1, 1, 2.5))]:
        log = spark.createDataFrame([(1, i, i, r) for i, r in enumerate(ratings)], REVIEW)
        row = st.sm2_replay(log).first()
        assert (row["reps"], row["interval_days"], row["ease"]) == want


def test_sm2_batch_and_stream_match_brute_force(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for card in range(12):
        ratings = [rng.choice(["again", "hard", "good", "good", "easy"]) for _ in range(rng.randint(1, 80))]
        rows += [(card, i * 7_000_000_000 + card, card * 1000 + i, r) for i, r in enumerate(ratings)]
        want[card] = replay([(i * 7_000_000_000 + card, r) for i, r in enumerate(ratings)])
    df = spark.createDataFrame(rows, REVIEW).repartition(5)
    batch = {r["card_id"]: r for r in st.sm2_replay(df).collect()}
    assert {c: (r["reps"], r["interval_days"]) for c, r in batch.items()} == {c: w[:2] for c, w in want.items()}
    out, marks = shared_dir(spark), shared_dir(spark)
    files, _ = jobs.staged_in_order(df, "us", 3, "card_id")
    stream = spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", 2).parquet(files)
    jobs.run_to_end(jobs.sm2_stream(stream), "update", jobs.batch_writer(out), marks)
    assert spark.read.parquet(out).select("batch_id").distinct().count() > 1
    streamed = {r["card_id"]: r for r in jobs.latest_cards(spark, out).collect()}
    for c, w in want.items():
        assert (streamed[c]["reps"], streamed[c]["interval_days"], streamed[c]["n_reviews"]) == (*w[:2], batch[c]["n_reviews"])
        assert abs(streamed[c]["ease"] - w[2]) < 1e-9 and streamed[c]["next_review_us"] == batch[c]["next_review_us"]


def test_stream_state_survives_a_restart(spark):
    path, out, marks = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    for lo, ratings in [(0, ["good", "good"]), (2, ["easy", "again", "good"])]:
        spark.createDataFrame([(1, lo + i, lo + i, r) for i, r in enumerate(ratings)], REVIEW).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(REVIEW).parquet(path)
        jobs.run_to_end(jobs.sm2_stream(stream), "update", jobs.batch_writer(out), marks)
    row = jobs.latest_cards(spark, out).first()
    assert (row["n_reviews"], row["reps"], row["interval_days"]) == (5, 1, 1)


def test_reviews_beyond_the_last_date_are_rejected(spark):
    log = spark.createDataFrame([(1, i, i, "easy") for i in range(40)], REVIEW)
    row = st.sm2_replay(log).first()
    assert row["interval_days"] > 36_500 and row["n_rejected"] > 0 and row["n_reviews"] == 40
    assert row["reps"] == 40 - row["n_rejected"] == row["last_reviewed_us"] + 1
    again = st.sm2_replay(log.unionByName(spark.createDataFrame([(1, 40, 40, "again")], REVIEW))).first()
    assert (again["reps"], again["interval_days"], again["last_reviewed_us"]) == (0, 1, 40)


def test_grading_and_scores(spark):
    q = spark.createDataFrame([(1, "u", ["a", "b", "c", "d"], 1), (2, "u", ["a", "b", "c", "d"], 0), (3, "u", ["a", "b"], 1), (4, "u", ["a"], 0)], "question_id long, user string, options array<string>, correct_index int")
    a = spark.createDataFrame([(1, 1), (3, 7), (4, -1)], "question_id long, chosen int")
    g = st.grade_quizzes(q, a)
    assert {r["question_id"]: (r["is_correct"], r["selected_text"], r["correct_text"]) for r in g.collect()} == {
        1: (True, "b", "b"), 2: (False, "None", "a"), 3: (False, "None", "b"), 4: (False, "None", "a"),
    }
    s = st.quiz_scores(g, "user").first()
    assert (s["n_correct"], s["n_total"], s["score"], s["passed"]) == (1, 4, 25.0, False)


def test_sessions_stats_and_topics(spark):
    r = st.review_sessions(spark.createDataFrame([(1, 0, 0, "easy"), (1, 1, 1, "hard")], REVIEW)).orderBy("us").collect()
    assert [(x["correct_items"], x["score"], x["seconds"]) for x in r] == [(1, 100.0, 15), (0, 0.0, 15)]
    s = spark.createDataFrame(
        [("u", "QUIZ", "", 4, 3, 75.0), ("u", "QUIZ", "X", 2, 1, 50.0), ("u", "FLASHCARD", "X", 1, 1, 100.0), ("v", "FLASHCARD", None, 1, 0, 0.0)],
        "user_id string, session_type string, topic string, total_items int, correct_items int, score double",
    )
    stats = {x["user_id"]: tuple(x)[1:] for x in st.user_stats(s).collect()}
    assert stats == {"u": (2, 62.5, 1, 6), "v": (0, 0.0, 1, 0)}
    topics = {x["topic"]: (x["accuracy"], x["total_questions"]) for x in st.topic_breakdown(s).collect()}
    assert topics == {"General": (75.0, 4), "X": (50.0, 2)}
    assert {x["band"]: x["n"] for x in st.mastery_bands(st.topic_breakdown(s)).collect()} == {"fair": 1, "weak": 1}


def test_rate_audit_matches_brute_force_across_slices(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice(["ask", "user"]), rng.randint(0, 20_000_000_000)) for i in range(3000)]
    limits = gov.limits_table(spark, {"ask": (3, 60), "user": (5, 90)})
    got = {r["request_id"]: r["n_in_window"] for r in gov.rate_audit(spark.createDataFrame(rows, "request_id long, user string, scope string, us long"), limits, keep_all=True).collect()}
    span = {"ask": 60_000_000, "user": 90_000_000}
    want = {i: sum(1 for j, u2, s2, t2 in rows if u2 == u and s2 == s and t - span[s] <= t2 <= t) for i, u, s, t in rows}
    assert got == want
    burst = spark.createDataFrame([(i, "u", "ask", i * 500_000) for i in range(35)], "request_id long, user string, scope string, us long")
    assert gov.rate_audit(burst, gov.limits_table(spark)).count() == 5


def test_activity_sessions_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(u, rng.randint(0, 40_000_000_000)) for u in range(3) for _ in range(60)]
    got = {(r["user"], r["session_no"]): (r["start_us"], r["end_us"], r["n_events"]) for r in gov.activity_sessions(spark.createDataFrame(rows, "user long, us long")).collect()}
    want = {}
    for u in range(3):
        n, last = 0, None
        for t in sorted(t for v, t in rows if v == u):
            if last is None or t - last > 1_800_000_000:
                n += 1
                want[u, n] = (t, t, 0)
            a, _, c = want[u, n]
            want[u, n] = (a, t, c + 1)
            last = t
    assert got == want


def test_rate_stream_drops_late_rows(spark):
    path, out, marks = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    schema = "ts timestamp, user long, scope string"
    for rows in ([("2024-01-01 00:00:10", 1), ("2024-01-01 00:00:20", 1), ("2024-01-01 01:00:00", 1)], [("2024-01-01 00:00:30", 1), ("2024-01-01 01:00:05", 1)]):
        df = spark.createDataFrame([(t, u, "ask") for t, u in rows], "t string, user long, scope string")
        df.select(F.to_timestamp("t").alias("ts"), "user", "scope").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        jobs.run_to_end(jobs.rate_stream(stream), "update", jobs.batch_writer(out), marks)
    last = spark.read.parquet(out).groupBy("window_start").agg(F.max("n").alias("n")).orderBy("window_start").collect()
    assert [r["n"] for r in last] == [2, 2]


def test_note_stream_quarantines(spark):
    notes = spark.createDataFrame([(1, "Patient: Ann Lee called 415-555-0134.\n\nSecond part"), (2, "holds [PHONE_1] already")], "doc_id long, text string")
    files, root, secret, marks = jobs.staged_files(notes, 2), shared_dir(spark), shared_dir(spark), shared_dir(spark)
    jobs.run_to_end(spark.readStream.schema("doc_id long, text string").parquet(files), "append", jobs.note_sink(root, secret), marks)
    read = lambda t: spark.read.parquet(f"{root}/{t}")
    assert read("masked").first()["masked_text"] == "Patient: [PATIENT_1] called [PHONE_1].\n\nSecond part"
    assert [r["doc_id"] for r in read("quarantine").collect()] == [2]
    assert read("paragraphs").count() == 2 and spark.read.parquet(f"{secret}/mapping").count() == 2


def test_visibility_and_paging(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(50)], "i int, owner string")
    people = spark.createDataFrame([("a", False), ("boss", True)], "principal string, is_admin boolean")
    seen = gov.visible_rows(df, people, "owner").groupBy("principal").count().collect()
    assert {r["principal"]: r["count"] for r in seen} == {"a": 17, "boss": 50}
    assert gov.visible_to(df, "owner", "b", False).count() == 17 and gov.visible_to(df, "owner", "b", True).count() == 50
    assert [r["i"] for r in gov.page(df, 3, "i").collect()] == list(range(40, 50))
    assert [r["i"] for r in gov.page_after(df, "i", 9, 3).collect()] == [10, 11, 12]


def test_visible_sets_let_the_same_rows_through(spark):
    rows = [(i * 3, ["a", "b", "c"][i % 3]) for i in range(70_000)]
    df = spark.createDataFrame(rows, "row_id long, owner string")
    people = spark.createDataFrame([("a", False), ("c", False), ("x", True), ("y", True), ("nobody", False)], "principal string, is_admin boolean")
    sets, numbers = gov.visible_sets(df, people, "owner", "row_id")
    held = sets.collect()
    assert len(held) == 2 * 3 + 2 and sum(r.n_rows for r in held if r.principal == "a") == sum(1 for r in rows if r[1] == "a")
    for who in ("a", "x", "nobody"):
        want = [r for r in rows if who == "x" or r[1] == who]
        assert sorted(tuple(r) for r in gov.rows_of(df, sets, numbers, "row_id", who).collect()) == want


def test_every_page_by_its_directory(spark):
    rows = [(i % 17, i, f"t{i}") for i in range(95)]
    df = spark.createDataFrame(rows, "size long, row_id long, t string")
    directory, laid = gov.page_directory(df, "size", "row_id", size=10)
    assert directory.count() == 10
    for number in (1, 2, 9, 10, 11):
        got = [tuple(r) for r in gov.directory_page(laid, directory, number, "size", "row_id", size=10).collect()]
        assert got == sorted(rows)[(number - 1) * 10 : number * 10]


def test_only_admitted_requests_count(spark, tmp_path):
    import random

    rng = random.Random(2)
    log = sorted((1_700_000_000_000_000 + rng.randint(0, 300) * 1_000_000, i, rng.randint(1, 3), rng.choice(["ask", "quiz"])) for i in range(200))
    rows = spark.createDataFrame([(i, u, s, us) for us, i, u, s in log], "request_id long, user long, scope string, us long").withColumn("ts", F.timestamp_micros("us"))
    limits = gov.limits_table(spark, {"ask": (3, 60), "quiz": (1, 20)})
    files, span = jobs.staged_in_order(rows.select("request_id", "user", "scope", "ts", "us"), "us", 4, "user")
    jobs.state_store(spark)
    out = f"{tmp_path}/out"
    for batches in (2, None):
        stream = spark.readStream.schema("request_id long, user long, scope string, ts timestamp, us long").option("maxFilesPerTrigger", 2).parquet(files)
        jobs.run_to_end(jobs.admitted_stream(stream, limits, late=f"{span // 1_000_000 + 1} seconds"), "append", jobs.batch_writer(out), f"{tmp_path}/marks", batches)
    held, want = {}, {}
    for us, i, u, s in log:
        most, seconds = {"ask": (3, 60), "quiz": (1, 20)}[s]
        live = [t for t in held.get((u, s), []) if t > us - seconds * 1_000_000]
        want[i] = len(live) < most
        held[u, s] = [*live, us] if want[i] else live
    got = spark.read.parquet(out)
    assert {r.request_id: r.admitted for r in got.collect()} == want and got.select("batch_id").distinct().count() > 2


def test_keys_of_one_bucket_share_state_but_no_limit(spark, tmp_path):
    """Many users in few buckets, null ids and users among them, ids beyond a double's precision, and a key that comes back after its times ran out."""
    import random

    calls = []
    rng, big, at = random.Random(5), 1 << 60, 1_700_000_000_000_000
    log = sorted(((at + rng.randint(0, 400) * 1_000_000, big + i, rng.choice([None, *range(20)]), rng.choice(["ask", "quiz"])) for i in range(400)), key=lambda r: r[:2])
    rows = spark.createDataFrame([(i, u, s, us) for us, i, u, s in log] + [(None, 99, "ask", at)], "request_id long, user long, scope string, us long").withColumn("ts", F.timestamp_micros("us"))
    files, span = jobs.staged_in_order(rows.select("request_id", "user", "scope", "ts", "us"), "us", 3, "user")
    jobs.state_store(spark)
    rules, out = {"ask": (2, 40), "quiz": (1, 20)}, f"{tmp_path}/out"
    stream = spark.readStream.schema("request_id long, user long, scope string, ts timestamp, us long").option("maxFilesPerTrigger", 2).parquet(files)
    admitted = jobs.admitted_stream(stream, gov.limits_table(spark, rules), late=f"{span // 1_000_000 + 1} seconds", buckets=2)
    jobs.run_to_end(admitted, "append", lambda batch, no: (calls.append(no), jobs.batch_writer(out)(batch, no)), f"{tmp_path}/marks")
    held, want = {}, {(None, 99): True}
    for us, i, u, s in log:
        most, seconds = rules[s]
        live = [t for t in held.get((u, s), []) if t > us - seconds * 1_000_000]
        want[i, u] = len(live) < most
        held[u, s] = [*live, us] if want[i, u] else live
    got = spark.read.parquet(out)
    assert {(r.request_id, r.user): r.admitted for r in got.collect()} == want and len(calls) > 2


def test_late_rows_get_a_table_of_their_own(spark, tmp_path):
    sink = jobs.admission_sink(str(tmp_path), 10)
    kind = "request_id long, us long"
    sink(spark.createDataFrame([(1, 100), (2, 80)], kind), 0)
    for _ in range(2):  # a replay changes nothing
        sink(spark.createDataFrame([(3, 95), (4, 89), (5, 130)], kind), 1)
    sink(spark.createDataFrame([(6, 121), (7, 119)], kind), 2)
    ids = lambda t: sorted(r.request_id for r in spark.read.parquet(f"{tmp_path}/{t}").collect())
    assert ids("ontime") == [1, 2, 3, 5, 6] and ids("late") == [4, 7]
