"""Kept connections, tries, order of answers, and slices that carry their end on."""

import json
import threading
import time
import urllib.error
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_signals import clip
from tremolo.functions import dsp
from tremolo.sources import transport
from tremolo.sources.remote import RemoteAttack, RemoteModel, SlicedAttack
from tremolo.sources.transport import Patient, in_flight, pooled


@pytest.fixture
def service():
    """Answers with what it got; seen: connections, requests by body, most at a time; failing: how often a body fails first."""
    seen = {"connections": set(), "requests": Counter(), "now": 0, "most": 0, "failing": 0, "status": 503}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        timeout = 5

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            with lock:
                seen["connections"].add(self.client_address)
                seen["requests"][body] += 1
                fails = seen["requests"][body] <= seen["failing"]
                seen["now"] += 1
                seen["most"] = max(seen["most"], seen["now"])
            time.sleep(0.02)
            out = b"{}" if fails else body
            with lock:
                seen["now"] -= 1
            self.send_response(seen["status"] if fails else 200)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()
    server.server_close()


def test_connections_are_kept(service):
    url, seen = service
    transport._idle.clear()
    assert [pooled(f"{url}/a?b=c", {"k": k}, 5)["k"] for k in range(10)] == list(range(10))
    assert len(seen["connections"]) == 1
    got = list(in_flight(3, lambda k: pooled(url, {"k": k}, 5)["k"], ((k,) for k in range(30))))
    assert got == list(range(30)) and len(seen["connections"]) <= 3 and 1 < seen["most"] <= 3
    for c in next(iter(transport._idle.values())):
        c.sock.close()  # as a service does with connections that were idle for long
        c.sock = None
    assert pooled(url, {"k": 1}, 5) == {"k": 1}


def test_tries_again_and_gives_up(service):
    url, seen = service
    pauses = []
    patient = Patient(tries=3, pause=1.0, sleep=pauses.append)
    seen["failing"] = 2
    assert patient(url, {"k": 0}, 5) == {"k": 0} and len(pauses) == 2 and 0.5 <= pauses[0] <= 1 <= pauses[1] <= 2
    seen["failing"] = 3
    with pytest.raises(urllib.error.HTTPError):
        patient(url, {"k": 1}, 5)
    assert seen["requests"][json.dumps({"k": 1}).encode()] == 3
    seen["status"] = 404  # won't pass
    with pytest.raises(urllib.error.HTTPError):
        patient(url, {"k": 2}, 5)
    assert seen["requests"][json.dumps({"k": 2}).encode()] == 1
    with pytest.raises(OSError):
        Patient(tries=2, sleep=pauses.append)("http://127.0.0.1:1", {}, 1)


def test_deadline():
    now = [0.0]

    def slow(url, payload, timeout):
        now[0] += timeout
        raise TimeoutError

    timeouts = []
    patient = Patient(lambda *a: timeouts.append(a[2]) or slow(*a), tries=100, pause=1.0, deadline=100.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    with pytest.raises(TimeoutError):
        patient("http://x", {}, 40.0)
    assert now[0] <= 100 and timeouts[0] == 40 and timeouts[-1] < 40


def test_no_more_is_sent_after_an_error():
    sent = []

    def ask(k):
        sent.append(k)
        if k == 2:
            raise ValueError("no")
        return k

    got = []
    with pytest.raises(ValueError):
        for x in in_flight(2, ask, ((k,) for k in range(100))):
            got.append(x)
    assert got == [0, 1] and len(sent) < 10
    assert list(in_flight(4, ask, [])) == [] and list(in_flight(1, ask, [(5,)])) == [5]


def test_a_run_over_a_service_that_fails_twice(spark, service):
    url, seen = service
    seen["failing"] = 2
    c = clip(spark, *([0.1 * k, 0.2] for k in range(12))).coalesce(1)
    got = RemoteAttack("A", url, transport=Patient(tries=3, pause=0.001))(c).collect()
    assert {r.clip_id: r.audio for r in got} == {r.clip_id: r.audio for r in c.collect()} and [r.clip_id for r in got] == [r.clip_id for r in c.collect()]
    assert set(seen["requests"].values()) == {3}
    none = RemoteModel("M", url, 16000, 2).detect(c.limit(0).withColumn("bits", F.array(F.lit(1))))
    assert none.count() == 0


def _model(part, kept):
    """Depends on all that it is given and on what it shall keep."""
    y = np.cos(np.cumsum(part) * 0.3) + 0.01 * kept
    y[:kept] = part[:kept]
    return y


@pytest.mark.parametrize("n", [0, 1, 5, 11, 12, 13, 16, 24, 40, 63])
def test_slices_carry_their_end(n):
    size, overlap = 16, 4
    x = np.random.default_rng(n).normal(size=n)
    want, before = [], None
    stride = min(size - overlap, n)
    for k in range(n // stride if n else 0):
        part = [float(v) for v in x[k * stride : k * stride + size]]
        if before is not None:
            scale = max(part[:overlap]) / max(before[-overlap:])
            part[:overlap] = [v * scale for v in before[-overlap:]]
        before = list(_model(np.array(part), overlap if k else 0))
        want += before[overlap:] if k else before
    assert np.allclose(dsp.in_slices(x, size, overlap, _model), want)


def test_sliced_attack(spark):
    def served(url, payload, timeout):
        kept = round(payload["mask_start_secs"] * payload["sampling_rate"])
        return {"audio": _model(np.array(payload["audio"]), kept).tolist()}

    rng = np.random.default_rng(1)
    xs = [rng.normal(size=n) for n in (60, 16, 3)]
    attack = SlicedAttack("DiffusionAttack", "http://x", params={"diffusion_steps": 20}, limits={"diffusion_steps": 150}, transport=served, size=16, overlap=4)
    got = {r.clip_id: np.array(r.audio) for r in attack(clip(spark, *xs)).collect()}
    for i, x in zip(sorted(got), xs):
        y = dsp.in_slices(x, 16, 4, _model)
        want = (y - y.min()) / (y.max() - y.min()) * (x.max() - x.min()) + x.min()
        assert np.allclose(got[i], want) and np.isclose(got[i].max(), x.max())
    with pytest.raises(ValueError, match="half"):
        dsp.in_slices(xs[0], 8, 5, _model)
    assert (dsp.in_slices(np.zeros(40), 16, 4, lambda part, kept: part) == 0).all()
    with pytest.raises(ValueError, match="came back"):
        dsp.in_slices(xs[0], 16, 4, lambda part, kept: part[:3])
