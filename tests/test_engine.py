import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from folioflow.functions import services, tokens
from folioflow.operators.glossary import Glossary, parse_glossary
from folioflow.operators.translate import Breaker, FunctionEngine, HttpEngine, Limiter, Policy, ServiceError, Worker, translate_groups

POLICY = Policy(max_retries=3, retry_delay=1.0, interval=0.0, max_failures=3)


class Script:
    """An engine that answers by a list of texts, errors or functions."""

    def __init__(self, *answers, name="script"):
        self.answers, self.asked, self.name = list(answers), [], name

    def translate(self, text, prompt):
        self.asked.append(text)
        answer = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(answer, Exception):
            raise answer
        return answer(text) if callable(answer) else answer


def worker(*engines, glossary=None, policy=POLICY):
    waits = []
    w = Worker(list(engines), glossary or Glossary([]), policy, "To <tlang>", "auto", "X", sleep=waits.append)
    return w, waits


def test_retries_by_kind():
    w, waits = worker(Script(ServiceError("HTTP 500", 500), ServiceError("slow down", 429, 7.0), "ok"))
    assert w.unit("a") == ("ok", "script") and 0.5 <= waits[0] <= 1.5 and 7.0 in waits
    for error, tries in ((ServiceError("no", 401), 1), (ServiceError("finish_reason=length"), 1), (ServiceError("empty"), 2), (ServiceError("HTTP 500", 500), 3)):
        e = Script(error)
        with pytest.raises(ServiceError):
            worker(e)[0].unit("a")
        assert len(e.asked) == tries


def test_bisection_keeps_what_works():
    def merged(text):
        units = json.loads(text)
        if any(u["text"] == "bad" for u in units):
            raise ServiceError("HTTP 500", 500)
        return json.dumps([{"id": u["id"], "text": u["text"] + "!"} for u in reversed(units)])

    single = lambda text: (_ for _ in ()).throw(ServiceError("HTTP 500", 500)) if text == "bad" else text + "!"
    engine = Script(lambda t: merged(t) if t.startswith("[") else single(t))
    members = [{"id": str(i), "text": "bad" if i == 2 else f"t{i}"} for i in range(5)]
    out = {r[0]: r for r in worker(engine)[0].group(members)}
    assert {k: r[1] for k, r in out.items()} == {"0": "t0!", "1": "t1!", "2": None, "3": "t3!", "4": "t4!"} and out["2"][3]["kind"] == "Transient"


def test_fallback_for_single_units_and_splitting():
    assert worker(Script(ServiceError("no", 403)), Script("second", name="b"))[0].unit("a") == ("second", "b")
    short = Script(lambda t: t.strip().upper() if len(t) < 12 else (_ for _ in ()).throw(ServiceError("maximum context length")))
    assert worker(short)[0].unit("one two. three four")[0] == "ONE TWO.\nTHREE FOUR"


def test_broken_tokens_get_a_second_try_and_repair():
    text = "a {{etm_o_00000}}b{{etm_c_00000}}{{etm_n_00001}}"
    e = Script("x {{etm_c_00000}}", text)
    assert worker(e)[0].unit(text)[0] == text and len(e.asked) == 2
    assert worker(Script("plain"))[0].unit("{{etm_o_00000}}b{{etm_c_00000}}")[0] == "{{etm_o_00000}}plain{{etm_c_00000}}"


def test_breaker_and_limiter():
    w, _ = worker(Script(ServiceError("no", 401)))
    out = [w.group([{"id": str(i), "text": "a"}])[0][3]["message"] for i in range(5)]
    assert out == ["no"] * 3 + ["stopped"] * 2
    b = Breaker(2)
    for ok in (False, True, False):
        b.record(ok)
    assert not b.open
    now, waits = [0.0], []
    limiter = Limiter(2.0, clock=lambda: now[0], sleep=waits.append)
    limiter.acquire()
    limiter.acquire()
    limiter.defer(9.0)
    limiter.acquire()
    assert waits == [2.0, 9.0]


def test_glossary():
    pairs = parse_glossary("﻿AI\n人工智能\n\nAI model\nKI\n\nx\n\nAI\nIA\n", {"q": "z", " ": "no"})
    assert pairs == [("AI model", "KI"), ("AI", "IA"), ("q", "z"), ("x", "x")]
    g = Glossary(pairs)
    said = g.apply_of("模AI model, AIs, {{etm_o_00000}}AI{{etm_c_00000}}")
    assert said == f"模{g.tokens[0]}, AIs, {{{{etm_o_00000}}}}{g.tokens[1]}{{{{etm_c_00000}}}}"
    spaced = said.replace("{{etg", "{{ etg")
    assert g.restore_of(said, spaced) == "模KI, AIs, {{etm_o_00000}}IA{{etm_c_00000}}"
    with pytest.raises(ValueError):
        g.restore_of(said, "nothing")


def test_splitting_places():
    assert tokens.split_protected_of("a") is None
    assert tokens.split_protected_of("First one. Second") == ("First ", "one. Second")
    token = "{{etm_o_00000}}"
    left, right = tokens.split_protected_of("a" + token * 2)
    assert left + right == "a" + token * 2 and left.count("{{") == left.count("}}")


def test_prompts_and_bodies():
    assert services.prompt_of("<slang> to <tlang>", "Auto", "X") == "detected language to X"
    assert "{{etg_0123456789ab_000000}}" in services.prompt_of("p", "a", "b", markup=True, glossary=True)
    assert services.request_body("openai", "", "t", "p") == {"messages": [{"role": "system", "content": "p"}, {"role": "user", "content": "t"}], "temperature": 0.3}
    claude = services.request_body("claude", "m", "t", "p", sampling="top_p", extra={"max_tokens": 9, "k": 1}, stream=True)
    assert claude == {"model": "m", "max_tokens": 9, "system": "p", "messages": [{"role": "user", "content": "t"}], "top_p": 1.0, "stream": True, "k": 1}
    with pytest.raises(ValueError):
        services.request_body("openai", "m", "t", "p", extra={"model": "x"})
    assert services.tail_translation_of("Think. Say it.在我看来 abc") == "在我看来 abc"
    assert services.tail_translation_of("only ascii. text") == "only ascii. text"
    assert services.tail_translation_of("answer 茶，好") == "茶，好"


def events(*said, done=True):
    lines = [f'data: {json.dumps({"choices": [{"delta": {"content": t}}]}, ensure_ascii=False)}' for t in said]
    return ("\n\n".join([": hello", *lines, *(["data: [DONE]"] if done else [])]) + "\n").encode()


def test_streams():
    data = events("a", "é茶", None, "b")
    for size in (1, 2, 3, 1000):
        assert services.stream_text("openai", [data[i : i + size] for i in range(0, len(data), size)]) == "aé茶b"
    assert services.stream_text("openai", [b'data: {"choices":[]}\ndata: {"usage":{}}\ndata: {"choices":[{"delta":{"content":"x"},"finish_reason":"stop"}]}']) == "x"
    claude = b'data: {"type":"content_block_delta","delta":{"text":"hi"}}\r\ndata: {"type":"message_stop"}\r\n'
    assert services.stream_text("claude", [claude]) == "hi"
    for bad, what in ((events("a", done=False), "incomplete"), (b"data: {", "JSON"), (b"\xffdata:", "UTF-8"), (b'data: {"error":1}\n', "error"), (b'data: {"choices":[{"delta":{},"finish_reason":"length"}]}', "length"), (b"data: {}\n", "choices")):
        with pytest.raises(services.StreamError, match=what):
            services.stream_text("openai", [bad])


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        self.server.seen.append((dict(self.headers), body))
        status, said = self.server.answers.pop(0)
        self.send_response(status)
        self.send_header("Retry-After", "2")
        self.end_headers()
        self.wfile.write(json.dumps(said).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    s.seen, s.answers = [], []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_http_engine(server):
    url = f"http://127.0.0.1:{server.server_port}/"
    server.answers += [(429, {"error": "x"}), (200, {"choices": [{"message": {"content": "hi"}}]}), (200, {"content": [{"text": "a"}, {"text": "b"}]}), (200, {"choices": [{"finish_reason": "length"}]})]
    e = HttpEngine("e", url, "m", key="secret")
    with pytest.raises(ServiceError) as info:
        e.translate("t", "p")
    assert (info.value.kind, info.value.retry_after) == ("RateLimit", 2.0)
    assert e.translate("t", "p") == "hi" and server.seen[-1][0]["Authorization"] == "Bearer secret"
    assert HttpEngine("c", url, "m", "claude", key="s").translate("t", "p") == "ab" and "secret" not in repr(e)
    with pytest.raises(ServiceError, match="length"):
        e.translate("t", "p")


def test_other_services(server):
    url = f"http://127.0.0.1:{server.server_port}/"
    server.answers += [(200, {"data": " x "}), (200, {"data": {"translations": [{"text": "y"}]}}), (200, {"code": 1})]
    e = HttpEngine("d", url, kind="deeplx", langs=("auto", "ZH"))
    assert e.translate("t", "p") == "x" and server.seen[-1][1] == {"text": "t", "source_lang": "auto", "target_lang": "ZH"}
    assert e.translate("t", "p") == "y"
    with pytest.raises(ServiceError, match="format"):
        e.translate("t", "p")


def test_operator(spark):
    groups = spark.createDataFrame([("b", [(0, "x", "one"), (1, "y", "two")]), ("b", [(2, "z", "three")])], "book string, members array<struct<ord:long,id:string,text:string>>")
    got = translate_groups(groups, [FunctionEngine(str.upper, "up")], "p <tlang>", "A", "B", policy=POLICY).collect()
    assert {(r.id, r.text, r.engine_name, r.error) for r in got} == {("x", "ONE", "up", None), ("y", "TWO", "up", None), ("z", "THREE", "up", None)}


def test_pages_that_others_reach_into(spark):
    import random

    from folioflow.operators import packing

    rng = random.Random(5)
    rows, page = [], {"a": "p", "b": None}
    for i in range(400):
        book = rng.choice("ab")
        if rng.random() < 0.2:
            page[book] = rng.choice(["p", "q", "r", None, f"own{i}"])
        rows.append((book, page[book], i, "x" * rng.randrange(1, 30)))
    want, state = {}, {}
    for book, at, i, text in rows:
        last, held, start = state.get(book, ("none", 0, 0))
        if last != at or held + len(text) > 60:
            held, start = 0, i
        state[book] = (at, held + len(text), start)
        want[(book, i)] = start
    df = spark.createDataFrame(rows, "book string, page string, ord long, original string")
    got = {(r.book, r.ord): r.group_start for r in packing.merge_groups(df, 60).collect()}
    assert got == want


def test_tail_translation_column(spark):
    from pyspark.sql import functions as F

    from folioflow.functions import services

    cases = ["", "plain. text", "So: é. ü ä", "x. é. end", "é, ü - ä no dots here", "thinking. 好的。再见", "é and ü; ß", "a.b.ü.", "好" * 3000 + " ok", "a\nb é\nc", " .é. "]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", services.tail_translation(F.col("c")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: services.tail_translation_of(c) for i, c in enumerate(cases)}


def test_request_json_is_the_body(spark):
    import json

    from pyspark.sql import functions as F

    from folioflow.functions import services

    texts = ['a "b"\n', "é\\x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, more in (("openai", {"extra": {"seed": [1, "ü"]}, "stream": True}), ("claude", {"extra": {"max_tokens": 7}}), ("deepseek", {"sampling": "top_p", "top_p": 0.5})):
        rows = df.select("t", services.request_json(kind, "m", F.col("t"), 'Say "x"\n', **more).alias("j")).collect()
        assert all(json.loads(r.j) == services.request_body(kind, "m", r.t, 'Say "x"\n', **more) for r in rows)


def test_split_protected_by_brute_force(spark):
    import re

    from folioflow.plans import registry

    def plain(text):
        """Among all places, the best: after a sentence within the middle half if there is one, else any, by bytes from the middle."""
        if len(text) < 2:
            return (None, None)
        size = lambda i: len(text[:i].encode())
        held = [m.span() for m in re.finditer(r"\{\{et[mg]_[^{}]+\}\}", text)]
        free = [i for i in range(1, len(text)) if not any(a < i < b for a, b in held)]
        after = [i for i in range(1, len(text) + 1) if (text[i - 1].isspace() or text[i - 1] in ".!?;。！？；") and size(len(text) // 4) < size(i - 1) < size(len(text) * 3 // 4) and not any(a < i < b or a < i - 1 < b for a, b in held)]
        middle = size(len(text) // 2)
        for places in (after, free):
            if places:
                at = min(places, key=lambda i: (abs(size(i) - middle), i))
                return (text[:at], text[at:]) if at < len(text) else (None, None)
        return (None, None)

    folder = "/root/testdata/sf0.001"
    found = registry.queries()["split_protected"](spark, folder).collect()
    units = {r.ord: r.protected for r in registry.queries()["glossary_apply"](spark, folder).collect()}
    short = [r for r in found if len(units[r.ord]) <= 400]
    assert len(short) > 1000 and all((r.left, r.right) == plain(units[r.ord]) for r in short)
    assert len(found) == len(units) and all(r.left + r.right == units[r.ord] for r in found if r.left is not None)
