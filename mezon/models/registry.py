"""Systems that produce answers: what they are and how a worker gets one.

The library ships no model and calls no service by itself. A ``Translator`` is made once per Python
worker by a factory registered for its kind; the factories here need libraries or services that may
be missing and say so when called.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Translator(Protocol):
    def translate(self, text: str, context: str | None = None) -> str: ...


@dataclass(frozen=True)
class Spec:
    key: str
    kind: str
    model: str


# The registered systems.
SPECS = [
    Spec("nllb-1.3b", "nllb", "facebook/nllb-200-distilled-1.3B"),
    Spec("nllb-3.3b", "nllb", "facebook/nllb-200-3.3B"),
    Spec("gemma4-12b", "ollama_local", "gemma4:12b"),
    Spec("gemma4-26b", "ollama_local", "gemma4:26b"),
    Spec("gemma4-31b-cloud", "ollama_cloud", "gemma4:31b-cloud"),
    Spec("translategemma-12b", "ollama_local", "translategemma:12b"),
    Spec("translategemma-27b", "ollama_local", "translategemma:27b"),
    Spec("gemini-3.5-flash", "gemini", "gemini-3.5-flash"),
    Spec("neuronai-uzbek", "hf_local", "NeuronUz/NeuronAI-Uzbek"),
    Spec("tilmoch", "tilmoch", "tilmoch"),
]
#: Kinds that load large models into the worker.
HEAVY = {"nllb", "hf_local"}

_FACTORIES: dict[str, Callable[[Spec], Translator]] = {}


def register(kind: str, factory: Callable[[Spec], Translator]) -> None:
    """Set how translators of a kind are made; replaces what was set before."""
    _FACTORIES[kind] = factory


def factory_of(spec: Spec) -> Callable[[Spec], Translator]:
    if spec.kind not in _FACTORIES:
        raise ValueError(f"no factory for systems of kind {spec.kind!r}; register() one")
    return _FACTORIES[spec.kind]


def resolve(names: str | None, heavy: bool = True) -> list[Spec]:
    """Specs of a comma list, all for None or 'all'; unknown names raise. ``heavy=False`` leaves heavy kinds out."""
    by = {s.key: s for s in SPECS}
    keys = [s.key for s in SPECS] if names in (None, "", "all") else [n.strip() for n in names.split(",") if n.strip()]
    if unknown := [k for k in keys if k not in by]:
        raise ValueError(f"unknown systems: {', '.join(unknown)}")
    return [by[k] for k in keys if heavy or by[k].kind not in HEAVY]


def as_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.key, s.kind, s.model, i) for i, s in enumerate(SPECS)], "system string, kind string, model string, position int")


def openai_chat(base_url: str, api_key: str = "none", temperature: float = 0.0) -> Callable[[Spec], Translator]:
    """Factory for services that speak the OpenAI chat protocol."""

    def make(spec: Spec) -> Translator:
        from openai import OpenAI  # optional

        from mezon.models.calls import prompt_text

        client = OpenAI(base_url=base_url, api_key=api_key)

        class Chat:
            def translate(self, text: str, context: str | None = None) -> str:
                r = client.chat.completions.create(model=spec.model, temperature=temperature, messages=[{"role": "user", "content": prompt_text(text, context)}])
                return (r.choices[0].message.content or "").strip()

        return Chat()

    return make


def http_json(url: str, api_key: str, field: str = "text", result: str = "result", max_chars: int = 5000, timeout: float = 60) -> Callable[[Spec], Translator]:
    """Factory for paid services that take one text per POST; longer texts are refused before they are sent."""

    def make(spec: Spec) -> Translator:
        import json
        import urllib.request

        class Service:
            def translate(self, text: str, context: str | None = None) -> str:
                if len(text) > max_chars:
                    raise ValueError(f"text of {len(text)} characters; the service takes {max_chars}")
                body = json.dumps({field: text}).encode()
                request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": api_key})
                with urllib.request.urlopen(request, timeout=timeout) as r:
                    return json.load(r)[result]

        return Service()

    return make
