"""Toolchains of repositories (E27) and the CI workflows made from them (K6), as expressions over (language, frameworks, manifests, has_docker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cindersift.schema import looked_up

# What each language is built, tested, linted and audited with unless a manifest or a framework says otherwise.
MANAGER = {"python": "pip", "javascript": "npm", "java": "maven", "rust": "cargo", "go": "go", "ruby": "bundler"}
#: manifests, language and the manager that they mean, in order.
MANAGER_BY_MANIFEST = (("python", ("Pipfile",), "pipenv"), ("python", ("pyproject.toml",), "poetry"), ("javascript", ("pnpm-lock.yaml", "pnpm-workspace.yaml"), "pnpm"), ("javascript", ("yarn.lock",), "yarn"), ("java", ("build.gradle", "build.gradle.kts"), "gradle"))
RUNNER = {"python": "pytest", "javascript": "jest", "java": "JUnit (via maven/gradle)", "go": "go test", "rust": "cargo test", "ruby": "rspec"}
LINTER = {"python": "ruff", "javascript": "eslint", "java": "checkstyle (via maven/gradle)", "go": "golangci-lint", "rust": "clippy", "ruby": "rubocop"}
BUILDER = {"javascript": "npm run build", "go": "go build", "rust": "cargo build --release", "ruby": "bundler"}
VERSION = {"python": "3.12", "javascript": "20", "java": "21", "go": "1.22", "rust": "stable", "ruby": "3.3"}
# What a workflow runs, by package manager. -----------------------------------------------------------------------------
INSTALL = {"pip": "pip install -r requirements.txt", "poetry": "poetry install --no-interaction --no-root", "pipenv": "pipenv install --dev --system", "npm": "npm ci", "yarn": "yarn install --frozen-lockfile", "pnpm": "pnpm install --frozen-lockfile", "gradle": "./gradlew build", "maven": "mvn -B verify", "go": "go mod download", "cargo": "cargo build --release", "bundler": "bundle install --jobs 4 --retry 3"}
AUDIT = {"pip": "pip-audit --vulnerability-service osv", "poetry": "pip-audit", "pipenv": "pip-audit", "npm": "npm audit --audit-level=high", "yarn": "yarn audit --level high", "pnpm": "pnpm audit --audit-level=high", "gradle": "./gradlew dependencyCheckAnalyze", "maven": "mvn -B dependency-check:check", "go": "govulncheck ./...", "cargo": "cargo audit", "bundler": "bundle-audit check --update"}
TEST = {"pip": "pytest --cov=. --cov-report=xml", "poetry": "poetry run pytest --cov=. --cov-report=xml", "pipenv": "pytest --cov=. --cov-report=xml", "npm": "npm test -- --coverage", "yarn": "yarn test --coverage", "pnpm": "pnpm test --coverage", "gradle": "./gradlew test", "maven": "mvn -B test", "go": "go test -race ./...", "cargo": "cargo test --all-features", "bundler": "bundle exec rspec"}
SETUP = {"python": ("Python", "actions/setup-python@v5", "python-version"), "javascript": ("Node.js", "actions/setup-node@v4", "node-version"), "java": ("JDK", "actions/setup-java@v4", "java-version"), "go": ("Go", "actions/setup-go@v5", "go-version"), "rust": ("Rust", "dtolnay/rust-toolchain@stable", "toolchain"), "ruby": ("Ruby", "ruby/setup-ruby@v1", "ruby-version")}


def toolchains(repos: DataFrame) -> DataFrame:
    """package_manager, test_runner, lint_tool, build_tool and lang_version of each row."""
    language = F.col("language")
    uses = lambda name: F.coalesce(F.array_contains("frameworks", name), F.lit(False))
    manager = None
    for lang, names, m in MANAGER_BY_MANIFEST:
        there = (language == lang) & F.coalesce(F.arrays_overlap("manifests", F.array(*map(F.lit, names))), F.lit(False))
        manager = F.when(there, m) if manager is None else manager.when(there, m)
    script = language == "javascript"
    out = repos.withColumn("package_manager", manager.otherwise(looked_up(language, MANAGER, "unknown")))
    return out.withColumns(
        {
            "test_runner": F.when(script & (uses("Vitest") | uses("Vite")), "vitest").otherwise(looked_up(language, RUNNER, "language default")),
            "lint_tool": F.when(script & uses("Next.js"), "next lint").otherwise(looked_up(language, LINTER, "none")),
            "build_tool": F.when(language == "python", F.col("package_manager")).when(script & uses("Next.js"), "next build").when(script & uses("Vite"), "vite build").when(language == "java", F.when(F.col("package_manager") == "gradle", "gradle").otherwise("maven")).otherwise(looked_up(language, BUILDER, "make")),
            "lang_version": looked_up(language, VERSION, "latest"),
        }
    )


def _step(name: Column, run: Column) -> Column:
    return F.concat(F.lit("      - name: "), name, F.lit("\n        run: "), run)


def workflows(repos: DataFrame, name_col: str = "name") -> DataFrame:
    """K6: a workflow of each row: security scan, then build and test, then the container where there is one, then deployment."""
    out = toolchains(repos)
    manager, language = F.col("package_manager"), F.col("language")
    title = F.concat(F.initcap(F.coalesce(language, F.lit("App"))), F.when(F.size("frameworks") > 0, F.concat(F.lit(" / "), F.array_join("frameworks", ", "))).otherwise(""))
    setup = None
    for lang, (label, action, key) in SETUP.items():
        step = F.concat(F.lit(f"      - name: Set up {label} {VERSION[lang]}\n        uses: {action}\n        with:\n          {key}: '{VERSION[lang]}'"))
        setup = F.when(language == lang, step) if setup is None else setup.when(language == lang, step)
    checkout = F.lit("      - uses: actions/checkout@v4")
    other = "echo 'nothing is known for this language'"
    security = [checkout, _step(F.lit("Static analysis"), F.lit("semgrep scan --config auto --error")), _step(F.lit("Secrets"), F.lit("trufflehog filesystem . --only-verified")), _step(F.lit("File system"), F.lit("trivy fs --severity CRITICAL,HIGH --exit-code 1 ."))]
    build = [checkout, setup, _step(F.lit("Install"), looked_up(manager, INSTALL, other)), _step(F.lit("Dependency audit"), looked_up(manager, AUDIT, other)), _step(F.lit("Lint"), F.when(F.col("lint_tool") == "none", other).otherwise(F.col("lint_tool"))), _step(F.lit("Test"), looked_up(manager, TEST, other))]

    def job(name: str, needs: Column | None, steps: list[Column], more: str = "") -> Column:
        head = F.concat(F.lit(f"  {name}:\n"), F.concat(F.lit("    needs: "), needs, F.lit("\n")) if needs is not None else F.lit(""), F.lit(f"{more}    runs-on: ubuntu-latest\n    steps:\n"))
        return F.concat(head, F.concat_ws("\n", *steps))

    docker = F.coalesce("has_docker", F.lit(False))
    image = job("docker-build", F.lit("build-and-test"), [checkout, _step(F.lit("Image"), F.lit("docker build -t app ."))])
    deploy = job("deploy", F.when(docker, "docker-build").otherwise("build-and-test"), [checkout, _step(F.lit("Deploy"), F.lit("echo 'add the deployment commands here'"))], "    if: github.ref == 'refs/heads/main' && github.event_name == 'push'\n    environment: production\n")
    head = F.concat(F.lit("name: Secure CI/CD — "), F.col(name_col), F.lit(" ("), title, F.lit(")\non:\n  push:\n    branches: [main, develop]\n  pull_request:\n    branches: [main]\njobs:"))
    parts = [head, job("security-scan", None, security), job("build-and-test", F.lit("security-scan"), build), F.when(docker, image), deploy]
    return out.withColumn("workflow", F.concat(F.concat_ws("\n", *parts), F.lit("\n")))
