from __future__ import annotations

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from notegrain import server
from notegrain.config import Config
from notegrain.extractor import Extractor
from notegrain.operators.terminology import TerminologyStore


@pytest.fixture(scope="module")
def what(spark):
    lexicon = spark.createDataFrame([("chest pain", "C0008031", "Chest Pain", "FINDING", ["T184"])], "term string, cui string, preferred_name string, semantic_group string, semantic_types array<string>").cache()
    codes = spark.createDataFrame([("C0008031", "SNOMEDCT_US", "29857009", "A1", "PT", "Chest pain", True), ("C0008031", "ICD10CM", "R07.9", "A2", "PT", "Chest pain, unspecified", True)], "cui string, sab string, code string, aui string, tty string, str string, is_preferred boolean").cache()
    return server.Service(spark, Extractor(Config(), lexicon), lexicon, TerminologyStore(codes), wait=0.2)


@pytest.fixture(scope="module")
def ask(what):
    http = server.http_server(what, token="t0ken")
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(path, body=None, token="t0ken"):
        raw = body if isinstance(body, bytes | None) else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_address[1]}{path}", raw, {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    yield call
    http.shutdown()


def test_http(what, ask):
    status, body = ask("/extract", {"text": "No chest pain.", "doc_id": "a"})
    (mention,) = json.loads(body)["mentions"]
    assert status == 200 and (mention["cui"], mention["start"], mention["assertions"]["negated"]) == ("C0008031", 3, True)
    assert [ask(p, token="x")[0] for p in ("/health", "/info", "/metrics")] == [200, 401, 401]
    assert ask("/ready")[0] == 200 and json.loads(ask("/info")[1])["config"]["mode"] == "single:clinical"
    assert {r["code"] for r in json.loads(ask("/concepts/c0008031")[1])} == {"29857009", "R07.9"} and ask("/concepts/C1")[0] == 404 and ask("/nothing")[0] == 404
    assert [ask("/extract", b)[0] for b in ({"text": ""}, {"text": 5}, {}, [1], b"{")] == [422] * 5
    metrics = ask("/metrics")[1]
    assert "notegrain_documents_total 1" in metrics and "notegrain_http_422_total 5" in metrics and 'le="+Inf"' in metrics


def test_all_places_taken(what, ask):
    for _ in range(what.most):
        what.places.acquire()
    try:
        assert ask("/extract", {"text": "x"})[0] == 503
    finally:
        for _ in range(what.most):
            what.places.release()


def test_json_rpc(what):
    ask = lambda method, **params: {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}
    lines = [ask("initialize"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, ask("tools/list"), ask("tools/call", name="search_medical_terms", arguments={"term": " Chest Pain "}), ask("tools/call", name="crosswalk_medical_code", arguments={"source": "icd-10-cm", "code": "r07.9", "target": "SNOMEDCT_US"}), ask("tools/call", name="extract_clinical_concepts", arguments={"text": "No chest pain", "max_concepts": 0}), ask("resources/read", uri="notegrain://info"), ask("nonsense"), ask("tools/call", name="none")]
    out = io.StringIO()
    server.stdio_server(what, io.StringIO("\n".join(map(json.dumps, lines)) + "\n\nnot json\n"), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert answers[0]["result"]["serverInfo"]["name"] == "notegrain" and len(answers[1]["result"]["tools"]) == 4
    text = lambda k: answers[k]["result"]["content"][0]["text"]
    assert json.loads(text(2)) == [{"cui": "C0008031", "preferred_name": "Chest Pain"}] and json.loads(text(3))[0]["target_code"] == "29857009"
    assert answers[4]["result"]["isError"] and "max_concepts" in text(4) and "version" in answers[5]["result"]["contents"][0]["text"]
    assert [answers[k]["error"]["code"] for k in (6, 7, 8)] == [-32601, -32602, -32700]
