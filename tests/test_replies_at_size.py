"""Replies that are long or many."""

import time

from tessera.operators import validate
from tessera.plans.queries import QUERIES


def test_a_reply_that_is_nested_too_deep_is_given_up_early():
    began = time.process_time()
    assert all(validate.first_json("[" * 20_000) is None for _ in range(200))
    assert time.process_time() - began < 0.5  # counting its brackets took a second


def test_what_stands_behind_the_value_is_left_out():
    cases = {'[1, "]"] see [3]': '[1, "]"]', '{"a": [}': None, '{"a": "}"} {x}': '{"a": "}"}', '[[1]': None, "[1}]": None, "1": None}
    assert {k: validate.first_json(k) for k in cases} == cases


def test_replies_are_dealt_to_all_tasks(spark):
    assert "REPARTITION_BY_NUM" in QUERIES["reply_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
