"""Settings (Q1-Q7, S13): values with priorities, typed getters, component maps, TOML files."""

from __future__ import annotations

import os
import re
import tomllib
from pathlib import Path
from types import MappingProxyType

# Priorities by name, and the defaults.
PRIORITIES = {"default": 0, "command": 10, "addon": 15, "project": 20, "spider": 30, "cmdline": 40}
DEFAULTS = {
    "BOT_NAME": "weftcrawl",
    "USER_AGENT": "weftcrawl/0.1",
    "CONCURRENT_REQUESTS": 16,
    "CONCURRENT_REQUESTS_PER_DOMAIN": 8,
    "CONCURRENT_ITEMS": 100,
    "DOWNLOAD_DELAY": 0,
    "DOWNLOAD_TIMEOUT": 180,
    "DOWNLOAD_MAXSIZE": 1024 * 1024 * 1024,
    "DOWNLOAD_WARNSIZE": 32 * 1024 * 1024,
    "RANDOMIZE_DOWNLOAD_DELAY": True,
    "DEFAULT_REQUEST_HEADERS": {"Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en"},
    "RETRY_ENABLED": True,
    "RETRY_TIMES": 2,
    "RETRY_HTTP_CODES": [500, 502, 503, 504, 522, 524, 408, 429],
    "RETRY_PRIORITY_ADJUST": -1,
    "REDIRECT_ENABLED": True,
    "REDIRECT_MAX_TIMES": 20,
    "REDIRECT_PRIORITY_ADJUST": 2,
    "DEPTH_LIMIT": 0,
    "DEPTH_PRIORITY": 0,
    "DEPTH_STATS_VERBOSE": False,
    "URLLENGTH_LIMIT": 2083,
    "COOKIES_ENABLED": True,
    "COOKIES_DEBUG": False,
    "HTTP_USER": "",
    "HTTP_PASS": "",
    "HTTP_AUTH_DOMAIN": "",
    "COMPRESSION_ENABLED": True,
    "HTTPPROXY_ENABLED": True,
    "HTTPCACHE_ENABLED": False,
    "HTTPCACHE_DIR": "httpcache",
    "HTTPCACHE_EXPIRATION_SECS": 0,
    "HTTPCACHE_GZIP": False,
    "HTTPCACHE_IGNORE_HTTP_CODES": [],
    "HTTPCACHE_IGNORE_SCHEMES": ["file"],
    "HTTPCACHE_IGNORE_MISSING": False,
    "HTTPCACHE_POLICY": "dummy",
    "HTTPCACHE_ALWAYS_STORE": False,
    "HTTPCACHE_IGNORE_RESPONSE_CACHE_CONTROLS": [],
    "ROBOTSTXT_OBEY": True,
    "ROBOTSTXT_USER_AGENT": "",
    "SCHEDULER_DEBUG": False,
    "JOBDIR": "",
    "SCRAPER_SLOT_MAX_ACTIVE_SIZE": 5_000_000,
    "LOG_LEVEL": "DEBUG",
    "STATS_DUMP": True,
    "LOGSTATS_INTERVAL": 60.0,
    "CLOSESPIDER_ERRORCOUNT": 0,
    "CLOSESPIDER_ITEMCOUNT": 0,
    "CLOSESPIDER_PAGECOUNT": 0,
    "CLOSESPIDER_TIMEOUT": 0,
    "MEMUSAGE_ENABLED": True,
    "MEMUSAGE_CHECK_INTERVAL_SECONDS": 60.0,
    "MEMUSAGE_LIMIT_MB": 0,
    "MEMUSAGE_WARNING_MB": 0,
    "DOWNLOADER_MIDDLEWARES_BASE": {"RobotsTxt": 100, "DownloadTimeout": 300, "DefaultHeaders": 400, "HttpAuth": 410, "UserAgent": 500, "Retry": 550, "HttpCompression": 590, "Redirect": 600, "Cookies": 700, "HttpProxy": 750, "DownloaderStats": 850, "HttpCache": 900},
    "DOWNLOADER_MIDDLEWARES": {},
    "SPIDER_MIDDLEWARES_BASE": {"HttpError": 50, "Offsite": 500, "Referer": 700, "UrlLength": 800, "Depth": 900},
    "SPIDER_MIDDLEWARES": {},
    "EXTENSIONS_BASE": {"CoreStats": 0, "CloseSpider": 0, "LogStats": 0, "MemoryUsage": 0, "FeedExport": 0},
    "EXTENSIONS": {},
    "DUPEFILTER_DEBUG": False,
    "DOWNLOADER_STATS": True,
    "FEED_EXPORT_ENCODING": "",
    "FEED_EXPORT_INDENT": 0,
    "FEED_STORE_EMPTY": True,
    "FEEDS": {},
    "FEED_URI": "",
    "FEED_FORMAT": "",
    "HTTPERROR_ALLOW_ALL": False,
    "HTTPERROR_ALLOWED_CODES": [],
    "REFERER_ENABLED": True,
}
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration(x) -> float:
    """Seconds: numbers as they are, strings like 1h2m3.5s, else numbers in strings."""
    if isinstance(x, (int, float)):
        return float(x)
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", x.strip())
    if parts and "".join(a + b for a, b in parts) == x.strip().lstrip("+-"):
        return (-1 if x.strip().startswith("-") else 1) * sum(float(a) * _UNITS[b] for a, b in parts)
    return float(x)


def typed(extra: dict | None = None, **values) -> dict:
    """Q5: a spider's settings by names in small letters, held to the kinds of the defaults; None says nothing. Names of one's own go
    into extra."""
    out = dict(extra or {})
    for name, value in values.items():
        key = name.upper()
        if key not in DEFAULTS:
            raise TypeError(f"no setting {name!r}")
        kind = type(DEFAULTS[key])
        fits = isinstance(value, bool) if kind is bool else not isinstance(value, bool) and isinstance(value, (int, float, str) if kind in (int, float) else kind)
        if value is not None and not fits:
            raise TypeError(f"{name} is of kind {kind.__name__}")
        if value is not None:
            out[key] = duration(value) if kind in (int, float) and isinstance(value, str) else value
    return out


class Settings:
    def __init__(self, values: dict | None = None, priority: str | int = "project"):
        self._values = {k: (v, 0) for k, v in DEFAULTS.items()}
        self._frozen = False
        self.update(values or {}, priority)

    def set(self, key: str, value, priority: str | int = "project") -> None:
        """Q1: a higher or equal priority wins."""
        if self._frozen:
            raise TypeError("settings are frozen")
        p = PRIORITIES.get(priority, priority) if isinstance(priority, str) else priority
        if key not in self._values or p >= self._values[key][1]:
            self._values[key] = (value, p)

    def update(self, values: dict, priority: str | int = "project") -> None:
        for k, v in values.items():
            self.set(k, v, priority)

    def __getitem__(self, key: str):
        return self._values[key][0]

    def __contains__(self, key: str) -> bool:
        return key in self._values

    def get(self, key: str, default=None):
        return self._values.get(key, (default, 0))[0]

    def priority(self, key: str) -> int:
        return self._values.get(key, (None, -1))[1]

    def get_int(self, key: str, default: int = 0) -> int:
        try:
            return int(float(self.get(key, default)))
        except (TypeError, ValueError):
            return default

    def get_float(self, key: str, default: float = 0.0) -> float:
        try:
            return float(self.get(key, default))
        except (TypeError, ValueError):
            return default

    def get_bool(self, key: str, default: bool = False) -> bool:
        v = self.get(key, default)
        if isinstance(v, str):
            return {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False, "": False}.get(v.strip().lower(), default)
        return bool(v)

    def get_duration(self, key: str, default: float = 0.0) -> float:
        try:
            return duration(self.get(key, default))
        except (TypeError, ValueError):
            return default

    def get_list(self, key: str) -> list:
        v = self.get(key) or []
        return [x.strip() for x in v.split(",") if x.strip()] if isinstance(v, str) else list(v)

    def get_dict(self, key: str) -> dict:
        return dict(self.get(key) or {})

    def components(self, key: str) -> list[str]:
        """Q3: names of X_BASE and X in ascending order; a negative or null place takes one out."""
        both = self.get_dict(f"{key}_BASE") | self.get_dict(key)
        return [n for n, p in sorted(both.items(), key=lambda x: (x[1] if x[1] is not None else -1, x[0])) if p is not None and p >= 0]

    def freeze(self) -> MappingProxyType:
        """Q4."""
        self._frozen = True
        return MappingProxyType({k: v for k, (v, _) in self._values.items()})

    def copy(self) -> Settings:
        out = Settings()
        out._values = dict(self._values)
        return out

    def load(self, path: str | Path, priority: str | int = "addon") -> None:
        """Keys in capitals."""
        with open(path, "rb") as f:
            self.update({k.upper(): v for k, v in tomllib.load(f).items()}, priority)

    def autoload(self, variable: str = "WEFTCRAWL_SETTINGS", name: str = "weftcrawl.toml") -> str | None:
        """Q6: the file an environment variable names, else one in the working folder."""
        for path in (os.environ.get(variable), name):
            if path and Path(path).is_file():
                self.load(path)
                return path
        return None
