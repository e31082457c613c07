"""An embedder that asks a service: POST {model, input[]}, answered by {data: [{index, embedding}]}."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Sequence

from quillspark.functions.embed import Embedder, Refused, Unavailable, by_index

#: Answers that mean the request was too large, if it held several texts.
TOO_LARGE = (400, 413, 422)


def http_embedder(url: str, model: str, timeout: float = 30.0, key: str | None = None) -> Embedder:
    """Vectors from the service at url. It holds no connection, so it may be sent to executors as it is.

    Raises Refused for answers in TOO_LARGE, Unavailable for failing connections, 5xx and answers that aren't JSON;
    other answers are errors of the request.
    """
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})

    def embed(texts: Sequence[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": list(texts)}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=timeout) as answer:
                rows = json.loads(answer.read())["data"]
        except urllib.error.HTTPError as e:
            if e.code in TOO_LARGE:
                raise Refused(f"{url} answered {e.code}") from e
            if e.code >= 500:
                raise Unavailable(f"{url} answered {e.code}") from e
            raise
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise Unavailable(f"{url}: {e}") from e
        return by_index(rows)

    return embed
