"""Service configuration (S15): YAML or JSON with ${VAR}, ${VAR:-default} and $VAR; every section has a class, unknown keys are passed over."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace

VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}|\$(\w+)")


def expand(value, env: dict[str, str] | None = None):
    """Variables of the environment put in, all the way down; a variable that isn't set gives its default, else nothing."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return VARIABLE.sub(lambda m: env.get(m[1] or m[3], m[2] or ""), value)
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    return {k: expand(v, env) for k, v in value.items()} if isinstance(value, dict) else value


def listed(value) -> list[str]:
    """A list, or a text of comma-separated items."""
    if value is None or value == "":
        return []
    items = value if isinstance(value, list) else str(value).split(",")
    return [str(x).strip() for x in items if str(x).strip()]


class ConfigError(ValueError):
    pass


# Names of sections and fields, and their defaults.
@dataclass(frozen=True)
class Cors:
    enabled: bool = False
    allow_origins: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class OpenApi:
    enabled: bool = True
    docs_enabled: bool = False
    redoc_enabled: bool = False


@dataclass(frozen=True)
class Server:
    bind: str = "0.0.0.0"
    port: int = 8000
    cors: Cors = Cors()
    openapi: OpenApi = OpenApi()


@dataclass(frozen=True)
class Auth:
    mode: str = "api_key"
    scheme: str = "bearer"
    header_name: str = "Authorization"
    api_keys: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class RateLimit:
    enabled: bool = True
    scope: str = "ip"
    requests_per_minute: int = 10
    trust_proxy_headers: bool = False
    trusted_proxies: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Limits:
    max_body_bytes: int = 8_000_000
    max_files: int = 1
    max_text_chars: int = 200_000
    allowed_image_types: list[str] = field(default_factory=lambda: ["image/png", "image/jpeg", "image/webp"])
    max_image_bytes: int = 4_000_000


@dataclass(frozen=True)
class Timeouts:
    analyze_seconds: int = 90


@dataclass(frozen=True)
class Concurrency:
    max_in_flight_per_worker: int = 1


@dataclass(frozen=True)
class Security:
    auth: Auth = Auth()
    rate_limit: RateLimit = RateLimit()
    request_limits: Limits = Limits()
    timeouts: Timeouts = Timeouts()
    concurrency: Concurrency = Concurrency()


@dataclass(frozen=True)
class Queue:
    backend: str = "redis"
    redis_url: str = "redis://localhost:6379/0"
    queue_key: str = "tt:queue"
    job_key_prefix: str = "tt:job"
    job_ttl_seconds: int = 900


@dataclass(frozen=True)
class Report:
    default_format: str = "markdown"
    default_language: str = "en"


@dataclass(frozen=True)
class Model:
    provider: str = "openai"
    name: str = "gpt-4.1-mini"
    params: dict = field(default_factory=dict)
    aws_profile: str | None = None
    aws_region: str | None = None
    ollama_host: str | None = None


@dataclass(frozen=True)
class Engine:
    allowed_inputs: list[str] = field(default_factory=lambda: ["mermaid", "drawio", "threat-dragon", "image", "ir"])
    autodetect: bool = True
    report: Report = Report()
    model: Model = Model()


@dataclass(frozen=True)
class Redact:
    input_content: bool = True
    result_content: bool = True


@dataclass(frozen=True)
class Observability:
    log_level: str = "info"
    redact: Redact = Redact()


@dataclass(frozen=True)
class Config:
    server: Server = Server()
    security: Security = Security()
    queue: Queue = Queue()
    engine: Engine = Engine()
    observability: Observability = Observability()


#: Lists of which an empty one means the default.
NEVER_EMPTY = ("allowed_inputs", "allowed_image_types")


def made(kind, data: dict | None):
    """A class from a mapping: unknown keys are passed over, lists and flags are coerced, nested classes made."""
    out = {}
    for f in fields(kind):
        v, default = (data or {}).get(f.name), getattr(kind(), f.name)
        if v is None or (f.name in NEVER_EMPTY and not listed(v)):
            continue
        if is_dataclass(default):
            out[f.name] = made(type(default), v)
        elif isinstance(default, list):
            out[f.name] = listed(v)
        elif isinstance(default, bool):
            out[f.name] = v if isinstance(v, bool) else str(v).strip().lower() in ("1", "true", "yes", "on")
        else:
            out[f.name] = v if default is None else type(default)(v)
    return kind(**out)


def provider_ready(model: Model, env: dict[str, str] | None = None, images: bool = False) -> str | None:
    """What a model's provider lacks, null if nothing: the key that hosted ones need, images for a local one."""
    env, provider = os.environ if env is None else env, model.provider.lower()
    key = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}.get(provider)
    if key and not env.get(key):
        return f"{key} is required"
    return "images are not supported" if provider == "ollama" and images else None


def load(text: str, env: dict[str, str] | None = None) -> Config:
    import json

    env = os.environ if env is None else env
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ConfigError("the configuration is not JSON, and there is no YAML reader") from None
        data = yaml.safe_load(text)
    config = made(Config, expand(data or {}, env))
    auth, queue = config.security.auth, config.queue
    if auth.mode == "api_key" and not auth.api_keys:
        keys = listed(env.get("SERVE_API_KEYS")) or listed(env.get("SERVE_API_KEY"))
        if not keys:
            raise ConfigError("keys are asked for and none is configured: set security.auth.api_keys or SERVE_API_KEYS")
        config = replace(config, security=replace(config.security, auth=replace(auth, api_keys=keys)))
    if not ((data or {}).get("queue") or {}).get("redis_url") and env.get("REDIS_URL"):
        config = replace(config, queue=replace(queue, redis_url=env["REDIS_URL"]))
    if queue.backend != "redis":
        raise ConfigError(f"unknown queue backend {queue.backend!r}")
    return config
