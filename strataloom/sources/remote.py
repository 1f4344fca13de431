"""Whole objects and chunks over HTTP and mirrors: retries, tags, scores of mirrors, reads in order or hedged."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from ..operators.codec import decompress
from .ranges import read_local_range, read_url_range

TIMEOUT = 30


def _retried(act, what: str, retries: int, backoff: float, stats: dict | None, key: str):
    last: Exception | None = None
    for attempt in range(1, max(1, retries) + 1):
        _count(stats, f"{key}_requests")
        try:
            return act()
        except Exception as error:  # noqa: BLE001  any failure is worth another request
            last = error
            if attempt < max(1, retries):
                _count(stats, f"{key}_retries")
                time.sleep(backoff * 2 ** (attempt - 1))
    _count(stats, f"{key}_failures")
    raise OSError(f"{what} failed after {max(1, retries)} attempts: {last}") from last


def _count(stats: dict | None, name: str, n: int = 1) -> None:
    if stats is not None:
        stats[name] = stats.get(name, 0) + n


def read_url(url: str, retries: int = 3, backoff: float = 0.05, stats: dict | None = None) -> bytes:
    def act():
        with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
            return answer.read()

    data = _retried(act, f"GET {url}", retries, backoff, stats, "full_get")
    _count(stats, "bytes_received", len(data))
    return data


def head(url: str, retries: int = 3, backoff: float = 0.05, stats: dict | None = None) -> dict[str, str]:
    """The answer's headers, names in lower case."""

    def act():
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=TIMEOUT) as answer:
            return {k.lower(): v for k, v in answer.headers.items()}

    found = _retried(act, f"HEAD {url}", retries, backoff, stats, "head")
    _count(stats, "etag_observed", int("etag" in found))
    return found


@dataclass
class Client:
    """Reads of chunks from a pack and its mirrors. What it learns of tags and mirrors stays with it."""

    retries: int = 3
    backoff: float = 0.05
    hedge_delay: float = 0.0
    blacklist_after: int = 0
    blacklist_seconds: float = 60.0
    stats: dict = field(default_factory=dict)
    mirrors: dict[str, dict] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)

    def tag(self, url: str) -> str | None:
        """The object's tag, asked for once; None where there is none or it can't be had: chunks are verified anyway."""
        if url not in self.tags:
            try:
                found = head(url, self.retries, self.backoff, self.stats).get("etag")
            except OSError:
                return None
            if not found:
                return None
            self.tags[url] = found
        return self.tags[url]

    def mirror(self, pack: str) -> dict:
        base = pack.split("/packs/", 1)[0] + "/" if "/packs/" in pack else pack
        none = {"attempts": 0, "successes": 0, "failures": 0, "bytes_requested": 0, "hedged_attempts": 0, "blacklist_events": 0, "blacklisted_until": 0.0, "score": 0, "last_error": None}
        return self.mirrors.setdefault(base if "://" in pack else "local", none)

    def candidates(self, packs: list[str], now: float | None = None) -> list[str]:
        """In the order given, those of blacklisted mirrors last."""
        now = time.time() if now is None else now
        return sorted(dict.fromkeys(packs), key=lambda p: self.mirror(p)["blacklisted_until"] > now)

    def read_chunk(self, pack: str, chunk: dict, hedged: bool = False) -> bytes:
        """The raw bytes of a row (chunk_id, raw_len, codec, compressed_hash, pack_offset, pack_len), verified as stored and as raw."""
        seen = self.mirror(pack)
        seen["attempts"] += 1
        seen["bytes_requested"] += chunk["pack_len"]
        seen["hedged_attempts"] += hedged
        try:
            if "://" in pack:
                data = read_url_range(pack, chunk["pack_offset"], chunk["pack_len"], self.tag(pack), self.retries, self.backoff)
                _count(self.stats, "range_requests")
                _count(self.stats, "bytes_received", len(data))
            else:
                data = read_local_range(pack, chunk["pack_offset"], chunk["pack_len"])
            if hashlib.sha256(data).hexdigest() != chunk["compressed_hash"]:
                raise OSError(f"stored hash differs for chunk {chunk['chunk_id']}")
            raw = decompress(chunk["codec"], data, chunk["raw_len"])
            if hashlib.sha256(raw).hexdigest() != chunk["chunk_id"]:
                raise OSError(f"hash differs for chunk {chunk['chunk_id']}")
        except Exception as error:
            seen["failures"] += 1
            seen["last_error"] = str(error)[:240]
            if self.blacklist_after and seen["failures"] >= self.blacklist_after:
                seen["blacklisted_until"] = time.time() + max(0.0, self.blacklist_seconds)
                seen["blacklist_events"] += 1
                _count(self.stats, "mirror_blacklist_events")
            raise
        else:
            seen["successes"] += 1
            return raw
        finally:
            seen["score"] = seen["successes"] - seen["failures"]

    def read_ordered(self, packs: list[str], chunk: dict) -> bytes:
        """From the first mirror that has the chunk."""
        errors = []
        for pack in self.candidates(packs):
            try:
                return self.read_chunk(pack, chunk)
            except Exception as error:  # noqa: BLE001  any failure of a mirror leads to the next
                errors.append(f"{pack}: {error}")
        raise OSError(f"all mirrors failed for chunk {chunk['chunk_id']}: " + "; ".join(errors[:5]))

    def read_hedged(self, packs: list[str], chunk: dict) -> bytes:
        """The first two mirrors race, the second after a delay; if both fail, all of them in order."""
        racing = self.candidates(packs)[:2]
        if len(racing) < 2 or self.hedge_delay <= 0:
            return self.read_ordered(packs, chunk)
        _count(self.stats, "hedged_requests")
        pool = ThreadPoolExecutor(len(racing))
        try:
            running = {pool.submit(self.read_chunk, racing[0], chunk, True)}
            wait(running, timeout=self.hedge_delay)
            running.add(pool.submit(self.read_chunk, racing[1], chunk, True))
            while running:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                for one in done:
                    if one.exception() is None:
                        _count(self.stats, "hedged_wins")
                        return one.result()
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        return self.read_ordered(packs, chunk)

    def read(self, packs: list[str], chunk: dict, policy: str = "ordered") -> bytes:
        remote = any("://" in p for p in packs)
        return self.read_hedged(packs, chunk) if policy == "hedged" and remote and len(packs) > 1 else self.read_ordered(packs, chunk)

    def save_mirrors(self, path: str) -> None:
        kept = ("attempts", "successes", "failures", "blacklist_events", "score", "last_error")
        with open(path, "w") as file:
            json.dump({"schema": "strata.mirror-state", "version": 1, "mirrors": {k: {c: v[c] for c in kept} for k, v in self.mirrors.items()}}, file, indent=2, sort_keys=True)

    def load_mirrors(self, path: str) -> bool:
        """What a saved state says of mirrors; a missing or broken one is told in stats and changes nothing."""
        self.stats["mirror_state_loaded"] = False
        if os.path.exists(path):
            try:
                with open(path) as file:
                    held = json.load(file)["mirrors"]
                for base, seen in held.items():
                    self.mirror(base if "://" in base else "local").update(seen)
                self.stats["mirror_state_loaded"] = True
            except (ValueError, KeyError, AttributeError, TypeError) as error:
                self.stats["mirror_state_error"] = str(error)[:240]
        return self.stats["mirror_state_loaded"]
