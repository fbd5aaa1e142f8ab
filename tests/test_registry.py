import json

import pytest

from tidemark.operators import business, registry
from tidemark.operators.registry import Abi, Param
from tidemark.sources import files

TRANSFER = {"name": "Transfer", "type": "event", "inputs": [{"name": "from", "type": "address", "indexed": True}, {"name": "to", "type": "address", "indexed": True}, {"name": "value", "type": "uint256"}]}


def folder(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c" / "d").mkdir(parents=True)
    (tmp_path / "a.json").write_text(json.dumps([TRANSFER, {"name": "f", "type": "function"}]))
    (tmp_path / "b" / "one.json").write_text(json.dumps([TRANSFER | {"signature": "0xbad"}, {"name": "Other${SUFFIX}", "type": "event", "inputs": []}]))
    (tmp_path / "b" / "c" / "two.json").write_text("[]")
    (tmp_path / "b" / "c" / "d" / "deep.json").write_text("[]")
    return tmp_path


def test_files_in_order_and_depth(tmp_path):
    found = [p.name for p in files.find(folder(tmp_path), ".json")]
    assert found == ["a.json", "two.json", "one.json"]
    with pytest.raises(FileNotFoundError):
        files.find(tmp_path / "none")


def test_placeholders(monkeypatch):
    monkeypatch.setenv("FROM_ENV", "e")
    assert files.substitute("${A}${FROM_ENV}", {"A": "1"}) == "1e"
    with pytest.raises(ValueError):
        files.substitute("${NOT_THERE_AT_ALL}")


def test_load_filters_and_keeps_the_first(tmp_path):
    at = folder(tmp_path)
    got = registry.load(at, values={"SUFFIX": "X"})
    assert [a.name for a in got] == ["Transfer", "OtherX"]
    assert got[0].signature.startswith("ddf252ad") and got[0].n_topics == 3
    assert [a.name for a in registry.load(at, names=["transfer"], values={"SUFFIX": "X"})] == ["Transfer"]
    with pytest.raises(ValueError, match="missing"):
        registry.load(at, names=["missing"], values={"SUFFIX": "X"})
    assert [a.name for a in registry.load(at, "function", values={"SUFFIX": "X"})] == ["f"]


def test_signature_expands_tuples_everywhere():
    inner = Param("t", "tuple", components=(Param("a", "uint"), Param("b", "address[]")))
    abi = Abi("E", "event", (inner, Param("l", "tuple[2]", components=(inner,))))
    assert abi.canonical == "E((uint256,address[]),((uint256,address[]))[2])"


def test_definitions_by_path_and_name(tmp_path):
    (tmp_path / "2.json").write_text(json.dumps({"name": "Second", "events": [{"name": "A", "alias": "a", "conditions": [{"firstOperand": "v", "isFirstStatic": False, "secondOperand": 0, "isSecondStatic": True, "operator": "GT", "isNumber": True}]}]}))
    (tmp_path / "1.json").write_text(json.dumps([{"name": "First", "events": [{"name": "VET_TRANSFER", "alias": "t"}]}, {"name": "SECOND"}]))
    got = business.load(tmp_path)
    assert [d.name for d in got] == ["First", "SECOND"]
    assert business.needs_transfers(got) and business.abi_names(got) == []
    assert business.Definition.of(json.loads((tmp_path / "2.json").read_text())).aliases[0].conditions[0].second == "0"
    with pytest.raises(ValueError):
        business.load(tmp_path, ["nope"])
