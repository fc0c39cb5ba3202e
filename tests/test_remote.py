import threading
import time
import urllib.error
import urllib.request
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from ratingmill.operators import remote, scoring


class Judge:
    """A server that counts its open requests, its calls by prompt, and its answers."""

    def __init__(self):
        own = self
        self.lock, self.open, self.most, self.calls, self.answers = threading.Lock(), 0, 0, Counter(), Counter()

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                prompt = self.rfile.read(int(self.headers["Content-Length"])).decode()
                with own.lock:
                    own.open += 1
                    own.most = max(own.most, own.open)
                    own.calls[prompt] += 1
                    n = own.calls[prompt]
                time.sleep(0.02)
                status, text = own.reply(prompt, n)
                with own.lock:
                    own.open -= 1
                    own.answers[prompt] += status == 200
                self.send_response(status)
                self.end_headers()
                self.wfile.write(text.encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def reply(self, prompt, n):
        if prompt.startswith("flaky") and n < 3:
            return 503, ""
        if prompt.startswith("down"):
            return 503, ""
        if prompt.startswith("silent") or prompt.startswith("late") and n < 3:
            return 200, "hm"
        return 200, f"1 to 10: {1 + len(prompt) % 10}"


@pytest.fixture
def judge():
    j = Judge()
    yield j
    j.server.shutdown()


def asking(url):
    def ask(prompt):
        return urllib.request.urlopen(urllib.request.Request(url, prompt.encode()), timeout=30).read().decode()

    return ask


OPTIONS = scoring.JudgeOptions(default=5.0, retries=5, concurrency=6, backoff_s=0.001)
ERRORS = (urllib.error.HTTPError,)


def test_budget_rounds_and_log(spark, judge, tmp_path):
    prompts = [f"plain {'x' * (i % 9)} {i}" for i in range(60)] + [f"{k} {i}" for k in ("flaky", "late", "silent") for i in range(4)]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(prompts)], "id int, prompt string, answer string").repartition(9)
    score = remote.remote(asking(judge.url), ["id"], f"{tmp_path}/log", OPTIONS, ERRORS, log_every=5)
    got = {r.prompt: r.score for r in score(df).collect()}
    assert got == {p: 5.0 if p.startswith("silent") else float(1 + len(p) % 10) for p in prompts}
    assert 1 < judge.most <= 6
    assert all(judge.answers[p] == (5 if p.startswith("silent") else 3 if p.startswith("late") else 1) for p in prompts)
    before = sum(judge.calls.values())
    again = score(df.unionAll(spark.createDataFrame([(99, "new", "x")], df.schema)))
    assert again.columns == ["id", "prompt", "answer", "score"] and again.count() == len(prompts) + 1
    assert sum(judge.calls.values()) == before + 1  # only the new request is asked for


def test_a_lost_task_asks_for_what_the_log_lacks(spark, judge, tmp_path):
    df = spark.createDataFrame([(i, f"p {i}") for i in range(20)], "id int, prompt string")
    flag, send = str(tmp_path / "failed"), asking(judge.url)

    def ask(prompt):
        import os

        if prompt == "p 13" and not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("lost")
        return send(prompt)

    score = remote.remote(ask, ["id"], f"{tmp_path}/log", scoring.JudgeOptions(default=5.0, retries=1, concurrency=1), ERRORS, log_every=1)
    with pytest.raises(Exception, match="lost"):
        score(df)
    half = sum(judge.calls.values())
    assert score(df).where("score is not null").count() == 20
    assert 0 < half < 20 and sum(judge.calls.values()) == 20 and max(judge.calls.values()) == 1


def test_errors_are_tried_seven_times_and_others_not_at_all(spark, judge, tmp_path):
    down = spark.createDataFrame([(1, "down")], "id int, prompt string")
    with pytest.raises(Exception, match="503"):
        remote.remote(asking(judge.url), ["id"], f"{tmp_path}/a", OPTIONS, ERRORS)(down)
    assert judge.calls["down"] == 7
    with pytest.raises(Exception, match="503"):
        remote.remote(asking(judge.url), ["id"], f"{tmp_path}/b", OPTIONS, (KeyError,))(down)
    assert judge.calls["down"] == 8
    with pytest.raises(Exception, match="503"):
        scoring.asked(asking(judge.url), OPTIONS, errors=ERRORS)(down).collect()
    assert judge.calls["down"] == 15
    silent = scoring.asked(asking(judge.url), OPTIONS, errors=ERRORS)(down.withColumn("prompt", F.lit("silent"))).first()
    assert silent.score == 5.0 and judge.answers["silent"] == 5
    assert remote.remote(asking(judge.url), ["id"], f"{tmp_path}/c", OPTIONS)(down.limit(0)).count() == 0
    assert [sum(remote.shares(50, n)) for n in (1, 7, 50, 400)] == [50] * 4 and max(remote.shares(3, 8)) == 1
