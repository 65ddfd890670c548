"""Rule packs by language and configuration kind (R6-R8, R10), as data for the rule engine.

Fixed values: id, severity, confidence, exploitability, blast radius, pattern, issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cindersift.operators.rules import Rule, all_matches, first_matches


def _pack(*rows: tuple) -> tuple[Rule, ...]:
    return tuple(Rule(i, severity, pattern, issue, confidence=c, exploitability=e, blast=b) for i, severity, c, e, b, pattern, issue in rows)


SCRIPT = _pack(
    ("l2/js-taint-sqli", "critical", 0.70, 0.75, 8, r"(?i)(req\.body|req\.query|req\.params|request\.body|event\.data)\s*[\.\[]?\s*\w*\s*[^=]*\s*(?:execute|query|db\.run|pool\.query)", "Request data in a database query"),
    ("l2/js-taint-xss", "high", 0.70, 0.70, 6, r"(?i)(req\.body|req\.query|req\.params)\s*[\.\[]?\s*\w*\s*[^=]*\s*(?:innerHTML|eval|document\.write)", "Request data in markup"),
    ("l2/js-taint-command-injection", "critical", 0.75, 0.80, 9, r"(?i)(req\.body|req\.query)\s*[\.\[]?\s*\w*\s*[^=]*\s*(?:exec|execSync|spawn)", "Request data in a shell command"),
    ("l2/js-taint-open-redirect", "medium", 0.70, 0.55, 5, r"(?i)(res\.redirect|location\.href\s*=)\s*[^;]{0,50}(req\.|request\.|query\.)", "Request data as a redirect target"),
    ("l2/js-auth-no-rate-limit", "medium", 0.50, 0.55, 5, r"""(?i)router\.(post|put)\s*\(["']/?(login|signin|auth)["']""", "Login route without a visible rate limit"),
    ("l2/js-jwt-no-verify", "critical", 0.95, 0.90, 8, r"(?i)jwt\.decode\s*\([^)]+,\s*\{[^}]*verify\s*:\s*false", "Token decoded without verification"),
    ("l2/js-sensitive-route-exposed", "high", 0.55, 0.65, 7, r"""(?i)app\.(get|post|put|delete)\s*\(["'][^"']*?(config|admin|backup|debug|internal)[^"']*["']""", "Sensitive route"),
)
JAVA = _pack(
    ("l2/java-runtime-exec-concat", "critical", 0.85, 0.80, 9, r"(?i)Runtime\.getRuntime\(\)\.exec\s*\([^)]*\+", "Concatenated command"),
    ("l2/java-sqli", "critical", 0.85, 0.80, 8, r'(?i)Statement\s+\w+\s*=.*createStatement|executeQuery\s*\("\s*(SELECT|INSERT|UPDATE|DELETE).*\+', "Concatenated SQL"),
    ("l2/java-deserialization", "critical", 0.90, 0.85, 9, r"(?i)ObjectInputStream\s*\(\s*\w*\.getInputStream", "Deserialised network data"),
    ("l2/java-delete-via-get", "medium", 0.70, 0.50, 5, r"(?i)@RequestMapping.{0,100}method\s*=.*GET.*\bdelete\b", "Deletion by GET"),
)
GO = _pack(
    ("l2/go-exec-inject", "critical", 0.85, 0.80, 9, r"(?i)exec\.Command\s*\([^)]*\+", "Concatenated command"),
    ("l2/go-sqli-sprintf", "critical", 0.88, 0.80, 8, r'(?i)fmt\.Sprintf\s*\(\s*"[^"]{0,50}(SELECT|INSERT|UPDATE|DELETE)[^"]*%', "Formatted SQL"),
    ("l2/go-weak-hash", "high", 0.95, 0.50, 4, r"crypto/md5|crypto/sha1", "Weak hash"),
    ("l2/go-http-bind-all", "medium", 0.90, 0.40, 4, r'(?i)http\.ListenAndServe\s*\(\s*":', "Server on all interfaces"),
)
CRYPTO = _pack(
    ("l3/ecb-mode", "high", 0.95, 0.70, 5, r"""(?i)MODE_ECB|\.ECB\b|"ECB"|'ECB'""", "Cipher mode without chaining"),
    ("l3/des-3des", "high", 0.95, 0.60, 5, r"(?i)\b(DES|TripleDES|3DES)\b", "Weak cipher"),
    ("l3/rc4", "critical", 0.98, 0.65, 5, r"(?i)\bRC4\b|\bARC4\b|\barcfour\b", "Broken cipher"),
    ("l3/rc2", "high", 0.95, 0.55, 4, r"(?i)\bRC2\b", "Weak cipher"),
    ("l3/hardcoded-iv", "high", 0.90, 0.65, 6, r"""(?i)iv\s*=\s*(b["']\\x00{8,}["']|\[\s*0\s*(,\s*0\s*){7,}\]|"0{16,}")""", "Constant nonce"),
    ("l3/timing-oracle", "high", 0.70, 0.55, 6, r"(?i)if\s+\w+\s*==\s*\w+.*?(token|hmac|signature|hash|secret|mac)", "Comparison that leaks time"),
    ("l3/pbkdf2-low-iterations", "medium", 0.70, 0.45, 4, r"(?i)pbkdf2[_-]?hmac\s*\([^)]*,\s*(\d+)\s*\)", "Few key derivation rounds"),
    ("l3/tls-old-version", "high", 0.95, 0.60, 7, r"(?i)SSLv3|TLSv1\.0|ssl\.PROTOCOL_TLSv1\b|TLS_1_0", "Old protocol version"),
    ("l3/null-cipher", "critical", 0.98, 0.80, 8, r"(?i)TLS_NULL_WITH_NULL_NULL|SSL_NULL_WITH_NULL_NULL", "No encryption"),
    ("l3/rsa-weak-key", "high", 0.95, 0.65, 6, r"(?i)generate_private_key\s*\([^)]*\b(512|1024)\b", "Short key"),
    ("l3/seeded-random-crypto", "high", 0.80, 0.60, 5, r"random\.seed\s*\(|srand\s*\(", "Seeded randomness"),
    ("l3/dev-urandom-direct", "info", 0.50, 0.10, 1, r"(?i)/dev/urandom", "Direct randomness device"),
    ("l3/jwt-weak-secret", "high", 0.85, 0.70, 7, r"""(?i)jwt\.sign\s*\([^)]+,\s*["'][^"']{1,15}["']""", "Short signing secret"),
    ("l3/unauthenticated-cipher", "medium", 0.75, 0.55, 5, r"(?i)MODE_CBC|MODE_CTR|MODE_CFB", "Cipher without authentication"),
)
DOCKERFILE = _pack(
    ("l6/docker-latest-tag", "medium", 0.92, 0.45, 6, r"(?i)^FROM\s+.+:latest\b", "Unpinned image"),
    ("l6/docker-root-user", "high", 0.95, 0.70, 9, r"(?i)^USER\s+root\b|^USER\s+0\b", "Root user"),
    ("l6/docker-privileged", "critical", 0.98, 0.90, 10, r"(?i)--privileged|--cap-add\s+SYS_ADMIN|--cap-add=SYS_ADMIN", "Dangerous capability"),
    ("l6/docker-secret-in-env", "critical", 0.92, 0.80, 8, r"(?i)^(ENV|ARG)\s+(PASSWORD|SECRET|API_KEY|TOKEN|CREDENTIAL)\s*=\s*\S+", "Secret in the image"),
    ("l6/docker-add-url", "high", 0.90, 0.65, 7, r"(?i)^ADD\s+https?://", "Remote file without a check"),
    ("l6/docker-curl-pipe-shell", "critical", 0.95, 0.85, 10, r"(?i)curl\s+[^|]*\|\s*(sh|bash|python|perl|ruby)", "Download piped to a shell"),
    ("l6/docker-no-tls-verify", "high", 0.90, 0.65, 7, r"(?i)--no-check-certificate|wget\s+[^>]*--no-check-certificate", "Certificates not verified"),
    ("l6/docker-dangerous-port", "high", 0.90, 0.70, 8, r"(?i)^EXPOSE\s+(22|23|3389|5900)\b", "Management port"),
    ("l6/docker-no-healthcheck", "low", 0.85, 0.20, 3, r"(?i)HEALTHCHECK\s+NONE", "No health check"),
)
COMPOSE = _pack(
    ("l6/compose-host-network", "high", 0.95, 0.80, 9, r"(?i)network_mode\s*:\s*host", "Host network"),
    ("l6/compose-privileged", "critical", 0.98, 0.90, 10, r"(?i)privileged\s*:\s*true", "Privileged service"),
    ("l6/compose-host-root-mount", "critical", 0.98, 0.95, 10, r"(?i)volumes:\s*\n\s*-\s*/:/[^:]*:rw", "Host root mounted"),
    ("l6/compose-docker-sock", "critical", 0.98, 0.95, 10, r"(?i)-\s*/var/run/docker\.sock:/var/run/docker\.sock", "Daemon socket mounted"),
    ("l6/compose-hardcoded-secret", "critical", 0.85, 0.80, 8, r"(?i)(PASSWORD|SECRET|API_KEY|TOKEN)\s*:\s*[^\s\n]{3,}", "Secret in the configuration"),
    ("l6/compose-restart-always", "info", 0.90, 0.10, 2, r"(?i)restart\s*:\s*always", "Restarts always"),
)
KUBERNETES = _pack(
    ("l6/k8s-privilege-escalation", "high", 0.97, 0.80, 9, r"(?i)allowPrivilegeEscalation\s*:\s*true", "Privilege escalation"),
    ("l6/k8s-run-as-root", "high", 0.95, 0.75, 9, r"(?i)runAsRoot\s*:\s*true|runAsUser\s*:\s*0\b", "Root user"),
    ("l6/k8s-privileged-container", "critical", 0.98, 0.90, 10, r"(?i)privileged\s*:\s*true", "Privileged container"),
    ("l6/k8s-host-pid-ipc", "critical", 0.97, 0.85, 10, r"(?i)hostPID\s*:\s*true|hostIPC\s*:\s*true", "Host namespaces"),
    ("l6/k8s-host-network", "high", 0.97, 0.80, 9, r"(?i)hostNetwork\s*:\s*true", "Host network"),
    ("l6/k8s-service-account-token", "medium", 0.90, 0.55, 7, r"(?i)automountServiceAccountToken\s*:\s*true", "Account token mounted"),
    ("l6/k8s-writable-root-fs", "medium", 0.70, 0.50, 6, r"(?i)readOnlyRootFilesystem\s*:\s*false", "Writable root"),
    ("l6/k8s-no-resource-limits", "medium", 0.85, 0.45, 6, r"(?i)resources\s*:\s*\{\s*\}|limits\s*:\s*\{\s*\}", "No limits"),
)
WORKFLOWS = _pack(
    ("l6/gha-github-token-exposed", "medium", 0.80, 0.50, 6, r"(?i)GITHUB_TOKEN\s*:", "Token in a workflow"),
    ("l6/gha-old-checkout", "low", 0.90, 0.25, 4, r"(?i)uses:\s+actions/checkout@v[12]\b", "Old action"),
    ("l6/gha-pwn-request", "critical", 0.90, 0.85, 8, r"(?i)run:\s*.*\$\{\{\s*github\.event\.(issue|pull_request)\.", "Event text in a command"),
    ("l6/gha-pull-request-target", "high", 0.88, 0.80, 8, r"(?i)on:\s*\[?\s*pull_request_target\b", "Privileged trigger"),
    ("l6/gha-cache-poisoning", "low", 0.60, 0.35, 5, r"(?i)cache:\s*true|actions/cache@", "Shared cache"),
)
TERRAFORM = _pack(
    ("l6/tf-open-ingress", "high", 0.97, 0.80, 8, r'(?i)cidr_blocks\s*=\s*\[\s*"0\.0\.0\.0/0"\s*\]', "Open to everyone"),
    ("l6/tf-storage-not-encrypted", "high", 0.93, 0.65, 7, r"(?i)encryption\s*=\s*false|encrypted\s*=\s*false", "Not encrypted"),
    ("l6/tf-db-public", "critical", 0.97, 0.85, 9, r"(?i)publicly_accessible\s*=\s*true", "Public database"),
    ("l6/tf-no-deletion-protection", "high", 0.90, 0.70, 8, r"(?i)deletion_protection\s*=\s*false|force_destroy\s*=\s*true", "No deletion protection"),
    ("l6/tf-no-ha", "medium", 0.88, 0.50, 7, r"(?i)multi_az\s*=\s*false|backup_retention_period\s*=\s*0", "No second zone or backup"),
)

CODE = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rb", ".php", ".cs", ".c", ".cpp", ".rs", ".kt", ".swift", ".scala")
SLASHES = ("//", "/*", "*")


def routes() -> list[tuple[Column, tuple[Rule, ...], tuple[str, ...]]]:
    """(which files, which rules, what starts a comment) over columns filename, ext, file and probe (texts found in the content)."""
    name, ext = F.col("filename"), F.col("ext")
    container = (name == "Dockerfile") | F.startswith(name, F.lit("Dockerfile."))
    compose = F.startswith(name, F.lit("docker-compose."))
    yaml = ext.isin(".yaml", ".yml") & ~compose & ~container
    iac = ("#", "//", "/*", "<!--")
    return [
        (ext.isin(".js", ".ts", ".jsx", ".tsx"), SCRIPT, SLASHES),
        (ext == ".java", JAVA, SLASHES),
        (ext == ".go", GO, ("//",)),
        (ext.isin(*CODE), CRYPTO, ("#", *SLASHES)),
        (container, DOCKERFILE, iac),
        (compose & ~container, COMPOSE, iac),
        (yaml & F.col("cluster"), KUBERNETES, iac),
        (yaml & F.col("workflow"), WORKFLOWS, iac),
        (ext == ".tf", TERRAFORM, iac),
    ]


def slow_enough(hits: DataFrame) -> DataFrame:
    """Key derivation with at least 100,000 rounds is no finding; below 10,000 it is a high one."""
    rounds = F.regexp_extract("matched", r"(\d+)\s*\)$", 1).try_cast("long")
    slow = F.col("rule_id") == "l3/pbkdf2-low-iterations"
    return hits.where(~(slow & (rounds >= 100_000)) | ~slow).withColumn("severity", F.when(slow & (rounds < 10_000), "high").otherwise(F.col("severity")))


def routed_matches(line_rows: DataFrame) -> DataFrame:
    """First matches of every pack on the files it is for; lines carry repo, file, filename, ext, cluster, workflow, line and code."""
    return first_matches(slow_enough(all_matches(line_rows, routes())), "repo", "file")


def probed(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds what routing needs to know of the content."""
    cluster = F.contains(content, F.lit("apiVersion:")) | F.contains(content, F.lit("kind: Pod")) | F.contains(content, F.lit("kind: Deployment")) | F.contains(content, F.lit("kind: Service"))
    return files.withColumns({"cluster": F.coalesce(cluster, F.lit(False)), "workflow": F.coalesce(F.contains("file", F.lit(".github/workflows")) | F.contains(content, F.lit("runs-on")), F.lit(False))})
