import json
import uuid
from types import SimpleNamespace

from tamis.operators.enrichment import enrich, error_code, progress, split_dead_letters
from tamis.session import materialize


def make_send():
    def send(text, attempt):
        if text == "third" and attempt < 3:
            raise TimeoutError
        if text == "down":
            raise ConnectionResetError("gone")
        if text == "odd":
            raise KeyError("x")
        if text == "busy":
            return 503, "later " * 100
        if text == "html":
            return 200, "<html>"
        if text == "none":
            return 200, "{}"
        return 200, json.dumps({"translatedText": f"<{text}>"})

    return send


ROWS = [(1, 1, "good"), (2, 0, "third"), (3, 0, "down"), (4, 1, ""), (5, 1, None), (6, 0, "busy"), (7, 0, "html"),
        (8, 0, "none"), (9, 1, "odd"), (10, 0, "y" * 6000)]


def test_every_outcome_keeps_its_row(spark):
    df = spark.createDataFrame(ROWS, "id long, label int, text string")
    done = enrich(df, make_send(), "id", "label", "text", pause=0.0, tasks=2)
    done = materialize(done, "done")
    answered, dead = split_dead_letters(done)
    assert {r.id: (r.translated, r.attempts) for r in answered.collect()} == {
        1: ("<good>", 1), 2: ("<third>", 3), 10: (f"<{'y' * 4999}><{'y' * 1001}>", 1)}
    codes = {r.id: (r.code, r.attempts) for r in dead.withColumn("code", error_code()).collect()}
    assert codes == {
        3: ("client_error", 3), 4: ("empty_text", 0), 5: ("empty_text", 0), 6: ("http_503", 3), 7: ("bad_json", 3),
        8: ("no_translatedText_in_response", 3), 9: ("unexpected_error", 3)}
    assert progress(done).first().asDict() == {"processed": 10, "failed": 7}


def test_pauses_grow_and_bodies_are_shortened(spark, monkeypatch):
    slept = []
    monkeypatch.setattr("tamis.operators.enrichment.time", SimpleNamespace(sleep=slept.append))
    df = spark.createDataFrame([(1, 0, "down"), (2, 0, "busy"), (3, 0, "good" * 3000)], "id long, label int, text string")
    found = {r.id: r for r in enrich(df, make_send(), "id", "label", "text", pause=0.5, piece_chars=4000).collect()}
    assert found[1].error == "client_error: gone" and slept == [0.5, 1.0]
    assert len(found[2].error) == len("http_503: ") + 300
    assert found[3].translated == f"<{'good' * 1000}>" * 3


def test_a_second_run_sends_only_what_has_no_answer(spark, tmp_path):
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    plain = make_send()

    def send(text, attempt):
        (calls / f"{uuid.uuid4().hex}").write_text(f"{attempt} {text[:10]}")
        return plain(text, attempt)

    def sent():
        found = sorted(p.read_text() for p in calls.iterdir())
        for p in calls.iterdir():
            p.unlink()
        return found

    df = spark.createDataFrame([*ROWS, (11, 0, "good")], "id long, label int, text string")
    first = enrich(df, send, "id", "label", "text", pause=0.0, tasks=2, attempts=1, ledger=ledger)  # ended after one round
    want = len([r for r in ROWS if r[2]]) + 1  # the long text is two pieces, equal texts are sent once
    assert len(sent()) == want and {r.attempts for r in first.collect()} == {0, 1}
    reports = []
    options = {"pause": 0.0, "tasks": 2, "ledger": ledger, "chunk_pieces": 3, "report": reports.append}
    found = {r.id: r for r in enrich(df, send, "id", "label", "text", **options).collect()}
    again = sent()
    assert again and {a[0] for a in again} == {"2", "3"} and not [a for a in again if "good" in a]
    assert found[2].translated == "<third>" and found[11].translated == "<good>" and found[3].attempts == 3
    assert reports[-1]["sent"] == len(again) and reports[-1]["round"] == 2 and reports[0]["chunks"] > 1
    assert [r["sent"] for r in reports] == sorted(r["sent"] for r in reports)
    assert {r.id: r for r in enrich(df, send, "id", "label", "text", **options).collect()} == found and sent() == []


def test_texts_are_dealt_by_digest_once_and_failed_ones_are_read_where_they_lie(spark, tmp_path):
    df = spark.createDataFrame([*ROWS, (None, None, "good"), (3, 0, "down")], "id long, label int, text string")
    plans, ledger = [], str(tmp_path / "ledger")
    found = enrich(df, make_send(), "id", "label", "text", pause=0.0, tasks=2, ledger=ledger)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert "max(struct" not in plans[0]  # answers are not sorted to be compared with each other
    tried = spark.read.parquet(ledger)
    assert tried.where("error <> '' AND text IS NULL").count() == 0 == tried.where("error = '' AND text IS NOT NULL").count()
    assert sorted((r.id or 0, r.error.split(":")[0], r.attempts) for r in found.collect()) == [
        (0, "", 1), (1, "", 1), (2, "", 3), (3, "client_error", 3), (3, "client_error", 3), (4, "empty_text", 0), (5, "empty_text", 0),
        (6, "http_503", 3), (7, "bad_json", 3), (8, "no_translatedText_in_response", 3), (9, "unexpected_error", 3), (10, "", 1)]
