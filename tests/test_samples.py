"""Every rule of Appendix-sized packs has a file that it finds, judged by another matcher; literal texts that rules must and must not find."""

import pytest

from cindersift.operators import packs, surface
from cindersift.plans import samples

#: Multi-line, so no line can match it.
UNREACHABLE = {"l6/compose-host-root-mount"}


def test_every_rule_is_met():
    met = set().union(*(samples.expected(f, c) for f, c in samples.SAMPLES))
    own = {r.rule_id for pack, _, _ in samples.PLACES for r in pack} | {r.rule_id for r in surface.LEGACY_FILES}
    assert own - met == UNREACHABLE
    assert (len(surface.SURFACE), len(surface.LEGACY), len(surface.LEGACY_FILES), sum(len(p) for p, _, _ in samples.PLACES[1:10])) == (91, 60, 10, 62)
    assert any(not samples.expected(f, c) for f, c in samples.SAMPLES)


@pytest.mark.parametrize(
    "file, content, rule, there",
    [
        ("s.txt", 'aws_secret = "abcdefghijklmnopqrstuvwxyz0123456789ABCD"', "l1/aws-secret-key", True),
        ("s.txt", "# eval(x)", "l1/eval-exec", False),
        ("s.txt", "evaluate(x)", "l1/eval-exec", False),
        ("a.py", "hashlib.pbkdf2_hmac('sha256', p, s, 200000)", "l3/pbkdf2-low-iterations", False),
        ("a.py", "hashlib.pbkdf2_hmac('sha256', p, s, 20000)", "l3/pbkdf2-low-iterations", True),
        ("Dockerfile", "FROM a\nUSER app", "native/docker-run-as-root", False),
        ("pod.yaml", "privileged: true", "l6/k8s-privileged-container", False),
        ("pod.yaml", "kind: Pod\nprivileged: true", "l6/k8s-privileged-container", True),
    ],
)
def test_literal_texts(spark, file, content, rule, there):
    from cindersift.plans.scan import LAYERS, detected

    assert (rule in samples.expected(file, content)) == there
    df = spark.createDataFrame([("r", file, content)], "repo string, file string, content string")
    found = detected(df, layers={k: LAYERS[k] for k in ("line rules", "whole rules")})
    assert (rule in {r.rule_id for r in found.collect()}) == there
