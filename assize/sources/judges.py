"""Judges for adjudicate_live and judge_with: callables from a batch of prompts to a batch of answers.

They run inside the tasks, one batch after the other in a partition; an error fails the task, which Spark runs again."""

from __future__ import annotations

import json
import os
import subprocess
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

Judge = Callable[[list[str]], list[str]]


def scripted_judge(answers: dict[str, str], default: str) -> Judge:
    """Answers by prompt, for tests."""
    return lambda prompts: [answers.get(p, default) for p in prompts]


def process_judge(command: list[str], timeout: float = 600.0) -> Judge:
    """A local model behind a command: the prompt goes in as text, what it prints comes back stripped."""

    def ask(prompts: list[str]) -> list[str]:
        return [subprocess.run(command, input=p, capture_output=True, text=True, timeout=timeout).stdout.strip() for p in prompts]

    return ask


def chat_judge(url: str, model: str, key_variable: str | None = None, temperature: float = 0.1, at_once: int = 8, timeout: float = 600.0) -> Judge:
    """A chat service that takes {model, messages, temperature} and answers with choices[0].message.content."""

    def one(prompt: str) -> str:
        body = json.dumps({"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[key_variable]}"} if key_variable else {})
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"] or ""

    def ask(prompts: list[str]) -> list[str]:
        with ThreadPoolExecutor(at_once) as pool:
            return list(pool.map(one, prompts))

    return ask
