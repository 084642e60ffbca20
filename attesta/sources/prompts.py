"""The system prompt and the reply schema of a request: built in, or taken from files beside the settings."""

from __future__ import annotations

import json
import os

from attesta.schemas import CONFIDENCES, REPLY_JSON_SCHEMA, TYPES

PROMPT_FILE, SCHEMA_FILE = "system-instruction.md", os.path.join("schemas", "facts.json")

#: What the parts of a claim are for, by field name.
FIELDS = {
    "id": "a whole number, counting from 1 in the order in which the claims appear",
    "fact": "the claim as one full sentence that can be understood by itself",
    "type": "what kind of claim it is: " + ", ".join(TYPES),
    "confidence": "how sure the text makes it: " + ", ".join(CONFIDENCES) + "; low is for what the text only implies",
    "verbatim": "the words of the text that the claim rests on, copied sign by sign, or null where the claim is only implied",
}
DEFAULT = (
    "You are given a text. List every claim it makes that could be checked, leaving out opinions and nothing else.\n"
    'Answer with one JSON object that has the single key "facts", an array with an object for each claim, and nothing before or after it.\n'
    "Each of these objects has the following keys, in this order:\n" + "".join(f"- {k}: {v}.\n" for k, v in FIELDS.items())
)


def prompt(settings) -> str:
    """The prompt of the settings' folder, or else the built-in one."""
    try:
        with open(settings.resolve(PROMPT_FILE), encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return DEFAULT


def schema(settings) -> dict:
    """The reply schema of the settings' folder, or else the built-in one; one that is no JSON is an error."""
    path = settings.resolve(SCHEMA_FILE)
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return REPLY_JSON_SCHEMA
    except ValueError as e:
        raise ValueError(f"{path} is no JSON: {e}") from None
