"""Row extractors behind one protocol, configuration from the environment, and the choice between them."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.functions.stages import settled
from evigrain.lexicon import FALLBACK_NOTE
from evigrain.operators.extract import fields
from evigrain.operators.retrieve import joined_text
from evigrain.operators.scoring import expand
from evigrain.operators.validate import normalise_rows
from evigrain.schemas import EXTRACTED_FIELDS, MISSING

BACKENDS = ("llm", "regex", "auto")
# What stands in a configuration where a key is missing; the service used by default and who asks it.
PLACEHOLDERS = ("replace_with_your_openrouter_api_key", "your_openrouter_api_key", "sk-or-v1-your-key-here")
ROUTER, VENDOR, REFERER = "https://openrouter.ai/api/v1", "https://api.openai.com/v1", "http://localhost:8501"
TITLE = "evigrain"
SYSTEM = "You extract evidence from clinical studies and answer in JSON that is grounded in the sources."


def load_env(path: str = ".env") -> None:
    """KEY=VALUE lines into the environment; a variable that is set stays."""
    file = Path(path)
    for line in file.read_text().splitlines() if file.exists() else ():
        name, eq, value = line.strip().partition("=")
        if eq and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def usable(secret: str | None) -> bool:
    return bool(secret and secret.strip()) and secret.strip().lower() not in PLACEHOLDERS


class Service(NamedTuple):
    key: str
    base_url: str
    headers: Mapping[str, str]


def service(env: Mapping[str, str] | None = None) -> Service | None:
    """The service whose key is set, the router before the vendor; None without a usable key."""
    env = os.environ if env is None else env
    if usable(env.get("OPENROUTER_API_KEY")):
        headers = {"HTTP-Referer": env.get("OPENROUTER_HTTP_REFERER", REFERER), "X-Title": env.get("OPENROUTER_APP_TITLE", TITLE)}
        return Service(env["OPENROUTER_API_KEY"], env.get("OPENROUTER_BASE_URL", ROUTER), headers)
    return Service(env["OPENAI_API_KEY"], env.get("OPENAI_BASE_URL") or VENDOR, {}) if usable(env.get("OPENAI_API_KEY")) else None


def chat(service: Service, model: str, messages: list[dict], as_json: bool = False, timeout: float = 600.0) -> str:
    """The answer of a chat completion at temperature 0; an error carries the service's status and words."""
    body = {"model": model, "temperature": 0, "messages": messages} | ({"response_format": {"type": "json_object"}} if as_json else {})
    headers = {"Authorization": f"Bearer {service.key}", "Content-Type": "application/json", **service.headers}
    request = urllib.request.Request(service.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            said = json.load(reply)
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"Error {e.code}: {e.read().decode(errors='replace')[:2000]}") from e
    return said["choices"][0]["message"].get("content") or ""


class Extractor(Protocol):
    """The answer of a language model to a prompt, as JSON text {"rows": [...]}."""

    def __call__(self, prompt: str) -> str: ...


class Chat:
    """The model of a service as an extractor; without a service every call is an error. It travels to the tasks, which make the calls."""

    def __init__(self, model: str, service: Service | None):
        self.model, self.service = model, service

    def __call__(self, prompt: str) -> str:
        if self.service is None:
            raise RuntimeError("no usable OPENROUTER_API_KEY or OPENAI_API_KEY is set")
        return chat(self.service, self.model, [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}], as_json=True) or "{}"


class Recorded:
    """Recorded answers by study name, for tests and replays."""

    def __init__(self, answers: Mapping[str, str]):
        self.answers = dict(answers)

    def __call__(self, prompt: str) -> str:
        return self.answers.get(prompt.split("Study: ", 1)[1].split("\n", 1)[0], '{"rows": []}')


def prompt_for(question: str, study: str, passages: str) -> str:
    wanted = ", ".join(EXTRACTED_FIELDS)
    return (
        f"Question: {question}\nStudy: {study}\n\nReport every finding of this study that bears on the question, as a JSON object with a list "
        f'"rows". Each row is an object of strings with the fields {wanted}. Write "{MISSING}" where the passages say nothing; '
        f"source_anchor is a sentence quoted word for word from the passages.\n\nPassages:\n{passages}"
    )


def rows_of_answer(answer: str) -> list[dict]:
    """The rows of an answer; what is no list counts as none, what is no object is dropped."""
    loaded = json.loads(answer)
    rows = loaded.get("rows") if isinstance(loaded, dict) else None
    return [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []


def regex_rows(studies: DataFrame, question: str) -> DataFrame:
    """One evidence row for each study (source_file, passages) with text."""
    rows = settled(studies, {"_all": joined_text(F.col("passages"), "\n\n")}).where("_all <> ''")
    found = {n: F.coalesce(c, F.lit(MISSING)) for n, c in fields(F.col("_all"), expand(question)).items()}
    stem = F.regexp_replace("source_file", r"(?<=[^/])\.[^./]*$", "")
    rows = settled(rows, found | {"study_name": stem, "notes": F.lit(FALLBACK_NOTE), "source_file": F.lit(MISSING)}).drop("_all")
    return normalise_rows(rows, question)


def answered_rows(studies: DataFrame, question: str, extractor: Extractor, workers: int = 4, quiet: bool = False) -> DataFrame:
    """studies with the model's rows, one output row each; calls run in `workers` tasks at most. quiet: a failed call gives no rows."""
    header = lambda p: F.concat(F.lit("["), p["passage_id"], F.lit(" | file="), p["source_file"], F.lit(" | page="), F.coalesce(p["page_number"].cast("string"), F.lit(MISSING)), F.lit("]\n"), F.coalesce(p["text"], F.lit("")))
    asked = studies.withColumn("_said", F.array_join(F.transform("passages", header), "\n\n")).withColumn("_study", F.regexp_replace("source_file", r"(?<=[^/])\.[^./]*$", "")).select("source_file", "_study", "_said")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, study, said in frame.itertuples(index=False):
                try:
                    rows = rows_of_answer(extractor(prompt_for(question, study, said)))
                except Exception:
                    if not quiet:
                        raise
                    rows = []
                out += [[file, *(None if r.get(f, MISSING) is None else str(r.get(f, MISSING)) for f in EXTRACTED_FIELDS)] for r in rows]
            if out:
                yield pd.DataFrame(out, columns=["_file", *EXTRACTED_FIELDS])

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("_file", *EXTRACTED_FIELDS)])
    answers = asked.repartition(max(1, workers)).mapInPandas(ask, schema)
    own = studies.select(F.col("source_file").alias("_file"), "passages")
    return answers.join(own, "_file")


def extract_rows(studies: DataFrame, question: str, backend: str = "regex", extractor: Extractor | None = None, workers: int = 4) -> DataFrame:
    """Evidence rows of the studies: by the model, by patterns, or by the model with patterns where it gives no row."""
    if backend not in BACKENDS:
        raise ValueError(f"backend must be one of {', '.join(BACKENDS)}")
    if backend == "regex" or (backend == "auto" and extractor is None):
        return regex_rows(studies, question)
    if extractor is None:
        raise ValueError("the llm backend needs an extractor")
    answered = answered_rows(studies, question, extractor, workers, quiet=backend == "auto").persist()  # a call is paid for once
    rest = studies.join(answered.select(F.col("_file").alias("source_file")).distinct(), "source_file", "left_anti")
    return normalise_rows(answered.drop("_file"), question).unionByName(regex_rows(rest, question))
