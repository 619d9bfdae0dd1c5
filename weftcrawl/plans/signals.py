"""Signals and extensions (G1-G5): driver-side observers, called between rounds; the events themselves are a relation."""

from __future__ import annotations

import logging
from collections.abc import Callable
from enum import StrEnum

log = logging.getLogger("weftcrawl")


class Signal(StrEnum):
    # Names of the signals.
    ENGINE_STARTED = "engine_started"
    ENGINE_STOPPED = "engine_stopped"
    SCHEDULER_EMPTY = "scheduler_empty"
    SPIDER_OPENED = "spider_opened"
    SPIDER_IDLE = "spider_idle"
    SPIDER_CLOSED = "spider_closed"
    SPIDER_ERROR = "spider_error"
    REQUEST_SCHEDULED = "request_scheduled"
    REQUEST_DROPPED = "request_dropped"
    REQUEST_REACHED_DOWNLOADER = "request_reached_downloader"
    REQUEST_LEFT_DOWNLOADER = "request_left_downloader"
    RESPONSE_RECEIVED = "response_received"
    RESPONSE_DOWNLOADED = "response_downloaded"
    HEADERS_RECEIVED = "headers_received"
    BYTES_RECEIVED = "bytes_received"
    ITEM_SCRAPED = "item_scraped"
    ITEM_DROPPED = "item_dropped"
    ITEM_ERROR = "item_error"


class DontClose(Exception):
    """Raised by a handler of spider_idle: the crawl goes on."""


class Manager:
    def __init__(self):
        self._handlers: dict[Signal, list[tuple[int, Callable]]] = {}
        self._last = 0

    def connect(self, signal: Signal, handler: Callable) -> int:
        self._last += 1
        self._handlers.setdefault(signal, []).append((self._last, handler))
        return self._last

    def disconnect(self, signal: Signal, number: int) -> bool:
        before = self._handlers.get(signal, [])
        self._handlers[signal] = [x for x in before if x[0] != number]
        return len(self._handlers[signal]) < len(before)

    def disconnect_all(self, signal: Signal) -> None:
        self._handlers.pop(signal, None)

    def count(self, signal: Signal) -> int:
        return len(self._handlers.get(signal, []))

    def send(self, signal: Signal, **params) -> list[Exception]:
        """In the order of connection, to those connected when it begins; errors are collected."""
        errors = []
        for _, handler in list(self._handlers.get(signal, [])):
            try:
                handler(**params)
            except Exception as e:  # noqa: BLE001
                errors.append(e)
        return errors

    def send_and_log(self, signal: Signal, **params) -> None:
        for e in self.send(signal, **params):
            log.error("handler of %s failed: %s", signal, e)

    def may_close(self, **params) -> bool:
        """False if a handler of spider_idle objects."""
        return not any(isinstance(e, DontClose) for e in self.send(Signal.SPIDER_IDLE, **params))


class NotConfigured(Exception):
    pass


class Extensions:
    """Opened in ascending order, those not configured left out; closed in reverse."""

    def __init__(self, parts: list[tuple[int, str, object]]):
        self.parts = sorted(parts, key=lambda p: (p[0], p[1]))
        self.opened: list[object] = []

    def open(self, crawl) -> None:
        for _, _, e in self.parts:
            try:
                e.open(crawl)
            except NotConfigured:
                continue
            self.opened.append(e)

    def close(self) -> list[Exception]:
        errors = []
        for e in reversed(self.opened):
            try:
                e.close()
            except Exception as x:  # noqa: BLE001
                errors.append(x)
        return errors
