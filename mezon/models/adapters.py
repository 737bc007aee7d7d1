"""Factories for local models and services that need libraries of their own.

Each factory is called once per Python worker with a ``Spec`` and imports its library then, so that
nothing here is needed until a system of that kind runs. Answers are finished alike: reasoning taken
out, stripped, apostrophes canonical.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from mezon.functions.text import APOSTROPHES, TURNED_COMMA, TUTUQ
from mezon.models.registry import Spec, Translator, http_json, openai_chat, register

_REASONING = re.compile(r"<think>.*?</think>", re.S | re.I)
_AFTER_O_G = re.compile(f"([oOgG])[{APOSTROPHES}]")
_BETWEEN = re.compile(f"(?<=[a-zA-Z])[{re.sub(f'[{TURNED_COMMA}{TUTUQ}]', '', APOSTROPHES)}](?=[a-zA-Z])")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def finish(answer: str | None) -> str:
    text = _REASONING.sub("", answer or "").strip()
    return _BETWEEN.sub(TUTUQ, _AFTER_O_G.sub(rf"\1{TURNED_COMMA}", text))


class _Function:
    """A translator made of one function of text and context."""

    def __init__(self, call: Callable[[str, str | None], str | None]):
        self.call = call

    def translate(self, text: str, context: str | None = None) -> str:
        return finish(self.call(text, context))


def nllb(source: str = "eng_Latn", target: str = "uzn_Latn", beams: int = 4, batch: int = 16, most_tokens: int = 256) -> Callable[[Spec], Translator]:
    """Encoder-decoder models: sentences are translated in batches, shortest first; context is not used."""

    def make(spec: Spec) -> Translator:
        import torch
        from transformers import AutoModelForSeq2SeqLM, AutoTokenizer

        tokens = AutoTokenizer.from_pretrained(spec.model, src_lang=source)
        device = "cuda" if torch.cuda.is_available() else "cpu"
        model = AutoModelForSeq2SeqLM.from_pretrained(spec.model).to(device).eval()
        begin = tokens.convert_tokens_to_ids(target)

        def call(text: str, context: str | None) -> str:
            sentences = [s for s in _SENTENCE_END.split(text) if s.strip()]
            done: dict[str, str] = {}
            todo = sorted(set(sentences), key=len)
            for i in range(0, len(todo), batch):
                part = todo[i : i + batch]
                inputs = tokens(part, return_tensors="pt", padding=True, truncation=True).to(device)
                with torch.inference_mode():
                    out = model.generate(**inputs, forced_bos_token_id=begin, num_beams=beams, max_new_tokens=most_tokens)
                done.update(zip(part, tokens.batch_decode(out, skip_special_tokens=True)))
            return " ".join(done[s] for s in sentences)

        return _Function(call)

    return make


def gemini(api_key: str | None = None, thinking_budget: int = 0) -> Callable[[Spec], Translator]:
    """The Gemini service, at temperature 0; the key is ``GEMINI_API_KEY`` unless given."""

    def make(spec: Spec) -> Translator:
        from google import genai
        from google.genai import types

        from mezon.models.calls import prompt_text

        client = genai.Client(api_key=api_key or os.environ["GEMINI_API_KEY"])
        settings = types.GenerateContentConfig(temperature=0, thinking_config=types.ThinkingConfig(thinking_budget=thinking_budget))
        return _Function(lambda text, context: client.models.generate_content(model=spec.model, contents=prompt_text(text, context), config=settings).text)

    return make


def local_chat(most_tokens: int = 1024, repetition_penalty: float = 1.1, no_repeat: int = 8) -> Callable[[Spec], Translator]:
    """Local chat models, decoded greedily through their chat template with thinking switched off where it can be."""

    def make(spec: Spec) -> Translator:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        from mezon.models.calls import prompt_text

        tokens = AutoTokenizer.from_pretrained(spec.model)
        model = AutoModelForCausalLM.from_pretrained(spec.model, torch_dtype=torch.bfloat16, device_map="auto").eval()

        def template(message: list[dict]) -> str:
            plain = {"tokenize": False, "add_generation_prompt": True}
            try:
                return tokens.apply_chat_template(message, enable_thinking=False, **plain)
            except TypeError:  # templates that know no thinking
                return tokens.apply_chat_template(message, **plain)

        def call(text: str, context: str | None) -> str:
            inputs = tokens(template([{"role": "user", "content": prompt_text(text, context)}]), return_tensors="pt").to(model.device)
            with torch.inference_mode():
                out = model.generate(
                    **inputs, do_sample=False, max_new_tokens=most_tokens, repetition_penalty=repetition_penalty, no_repeat_ngram_size=no_repeat, pad_token_id=tokens.eos_token_id
                )
            return tokens.decode(out[0][inputs["input_ids"].shape[1] :], skip_special_tokens=True)

        return _Function(call)

    return make


def register_all(local_url: str = "http://localhost:11434/v1", cloud_url: str | None = None, cloud_key: str = "none", paid_url: str | None = None, paid_key: str = "") -> None:
    """Factories for every registered kind whose address is known."""
    register("nllb", nllb())
    register("hf_local", local_chat())
    register("gemini", gemini())
    register("ollama_local", openai_chat(local_url))
    if cloud_url:
        register("ollama_cloud", openai_chat(cloud_url, cloud_key))
    if paid_url:
        register("tilmoch", http_json(paid_url, paid_key))
