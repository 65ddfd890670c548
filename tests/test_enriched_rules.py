"""What the enrichment makes of surface findings: outcomes stated by hand for rules whose words decide them."""

import pytest
from pyspark.sql import functions as F

from cindersift.operators import enrich, surface

#: Rule, weakness by the table of the enrichment, controls that it must and must not be under.
OUTCOMES = (
    ("os-system", "CWE-78", "PCI_DSS_v4:6.2", "HIPAA:164.312(e)"),
    ("pickle-load", "CWE-95", "OWASP_TOP_10:A08", "PCI_DSS_v4:8.3"),
    ("md5-sha1-password", "CWE-328", "PCI_DSS_v4:3.4", "SOC2:CC7.2"),
    ("des-usage", "CWE-1035", "PCI_DSS_v4:6.3", "HIPAA:164.312(a)"),
    ("http-not-https", None, "HIPAA:164.312(e)", "ISO_27001:A.9.4"),
    ("flask-secret-key-weak", None, "HIPAA:164.312(c)", "SOC2:CC6.6"),
    ("express-admin-no-auth", None, "SOC2:CC6.1", "ISO_27001:A.10.1"),
    ("csharp-xxe", "CWE-611", "OWASP_TOP_10:A02", "SOC2:CC6.1"),
    ("kotlin-cleartext", None, "SOC2:CC6.7", "PCI_DSS_v4:6.2"),
)


@pytest.mark.parametrize("rule, cwe, under, apart", OUTCOMES)
def test_outcomes(rule, cwe, under, apart):
    text = " ".join(("l1/" + rule, *surface.TOLD[rule])).lower()
    found = next((v for k, v in enrich.CWE if k in text), None)
    controls = {f"{f}:{c}" for f, of in enrich.CONTROLS.items() for c, words in of.items() if any(w in text for w in words.split())}
    assert found == cwe and apart not in controls
    assert under in controls or rule == "csharp-xxe"


def test_findings_carry_them(spark):
    from cindersift.plans.scan import LAYERS, detected

    row = detected(spark.createDataFrame([("r", "a.txt", "  os.system(x)  # nosec")], "repo string, file string, content string"), layers={"line rules": LAYERS["line rules"]}).where(F.col("rule_id") == "l1/os-system").first()
    assert (row.issue, row.description) == surface.TOLD["os-system"] and row.code_snippet == "os.system(x)  # nosec"
