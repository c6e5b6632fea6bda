"""Scoring over HTTP: answers in place, chunks, schemas, several series of one endpoint."""

import json
import math
import urllib.error
import urllib.request

import numpy as np
import pytest

from molquarry import serve
from molquarry.operators.scoring import Members, ScoringService


@pytest.fixture(scope="module")
def server(tmp_path_factory):
    members = Members(lambda name: lambda texts: np.asarray([len(t) * (2.0 if name.startswith("MLP") else 1.0) for t in texts]), 2)
    service = ScoringService(members, {"GNN_seed0_fold0": 1.0, "MLP_seed0_fold0": 1.0}, {"radius": 3})
    path = tmp_path_factory.mktemp("serve") / "port"
    with serve.Server(service, port_file=str(path)) as s:
        assert serve.endpoint(port_file=str(path)) == s.url and serve.ready(s.url, 5)
        yield s


def test_scores_stay_in_place(server):
    texts = ["CC", None, "C(", "", "CCCC"] * 3
    got = serve.ask(server.url, texts, chunk=4)
    assert got["score"] == [3.0, None, None, None, 6.0] * 3 and len(got["spread"]) == 15
    one, two, again = serve.ask_all([(server.url, "score"), (server.url, "spread"), (server.url, "score")], texts)
    assert one[0] == 3.0 and two[0] == 1.0 and math.isnan(one[1]) and again[4] == 6.0
    assert serve.ask(server.url, []) == {}


def test_facts_and_faults(server):
    info = json.load(urllib.request.urlopen(f"{server.url}/info"))
    assert info == {"n_members": 2, "backends": {"GNN": 1, "MLP": 1}, "config": {"radius": 3}}
    for path, body, status in (("/predict", b"{", 422), ("/predict", b'{"smiles": "C"}', 422), ("/predict", b'{"smiles": [1]}', 422), ("/other", b"{}", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(server.url + path, body))
        assert e.value.code == status and json.load(e.value)["error"]
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{server.url}/nothing")
    assert not serve.ready("http://127.0.0.1:9", 0.3)
    assert serve.endpoint("http://h:1/") == "http://h:1"
    with pytest.raises(ValueError):
        serve.endpoint()
    with pytest.raises(serve.BadRequest):
        serve.parsed_request(json.dumps({"smiles": ["C"] * (serve.MOST_TEXTS + 1)}).encode())
