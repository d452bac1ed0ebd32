"""The price refresh as a job that is run again and again."""

from __future__ import annotations

import json
from pathlib import Path

from quire.operators import refresh as rf

DAY = 86400


def reader(folder):
    def model(prompt):
        vendor = prompt.split("\n", 1)[0].removeprefix("Vendor: ")
        (Path(folder) / f"{vendor}-{len(list(Path(folder).iterdir()))}").write_text("")
        if vendor == "down":
            raise ValueError("no answer")
        if vendor == "vague":
            return "no prices here"
        return json.dumps({"models": {"m0": {"input": 2, "output": 4 if "new list" not in prompt else 5}}, "note": vendor})

    return model


def tables(spark, text="price list " * 30):
    wanted = spark.createDataFrame([("acme", "m0"), ("vague", "m1"), ("down", "m2"), ("ollama", "m3"), ("short", "m4")], "provider string, model string")
    pages = spark.createDataFrame([(p, f"https://{p}.example", "tiny" if p == "short" else text) for p in ("acme", "vague", "down", "ollama", "short")], "provider string, source string, text string")
    quotes = spark.createDataFrame([("USD", 7.2, 1), ("USD", 0.0001, 0)], "currency string, rate double, source_rank int")
    return wanted, pages, quotes


def asked(folder):
    return sorted(p.name.split("-")[0] for p in Path(folder).iterdir())


def test_a_second_run_asks_only_what_is_still_open(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    book, log = rf.PriceBook(spark, str(tmp_path / "book")), str(tmp_path / "log")
    state, who = rf.refresh(book, 0, *tables(spark), reader(seen), 1000 * DAY, log)
    assert {(r.provider, r.model, r.output, r.updated_at) for r in state.prices.collect()} == {("acme", "m0", 4.0, 1000 * DAY)}
    assert [(r.currency, r.rate) for r in state.rates.collect()] == [("USD", 7.2)]
    assert sorted(r.provider for r in who.collect()) == ["acme", "down", "vague"] and asked(seen) == ["acme", "down", "vague"]
    # acme is fresh now; what vague said is in the log; only the call that failed is made again
    state, who = rf.refresh(book, 1, *tables(spark), reader(seen), 1001 * DAY, log)
    assert asked(seen) == ["acme", "down", "down", "vague"] and "acme" not in [r.provider for r in who.collect()]
    assert [(r.model, r.updated_at) for r in state.prices.collect()] == [("m0", 1000 * DAY)]
    assert [r.rate for r in state.rates.collect()] == [7.2]  # kept


def test_a_batch_run_again_replaces_itself_and_old_prices_are_read_again(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    book, log = rf.PriceBook(spark, str(tmp_path / "book")), str(tmp_path / "log")
    wanted, pages, quotes = tables(spark)
    only = wanted.where("provider = 'acme'")
    for _ in range(2):
        state, _ = rf.refresh(book, 0, only, pages, quotes, reader(seen), 10 * DAY, log)
        assert state.prices.count() == 1
    assert asked(seen) == ["acme"]  # the same prompt, answered from the log
    later = tables(spark, "new list " * 40)[1]
    state, _ = rf.refresh(book, 1, only, later, quotes, reader(seen), 18 * DAY, log)
    assert [(r.output, r.updated_at) for r in state.prices.collect()] == [(5.0, 18 * DAY)] and asked(seen) == ["acme", "acme"]
    state, who = rf.refresh(book, 2, only, later, quotes, reader(seen), 19 * DAY, log)
    assert who.count() == 0 and state.prices.count() == 1 and len(asked(seen)) == 2


def test_models_that_are_not_seen_again_stay(spark, tmp_path):
    old = spark.createDataFrame([("acme", "old", 1.0, 1.0, 2.0, 5, "s", "n"), ("acme", "m0", 1.0, 1.0, 2.0, 5, "s", "n")], rf.PRICES)
    new = spark.createDataFrame([("acme", "m0", 3.0, 3.0, 4.0, 9, "s", "n")], rf.PRICES)
    assert {(r.model, r.input) for r in rf.merged_prices(old, new).collect()} == {("old", 1.0), ("m0", 3.0)}
