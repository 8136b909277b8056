"""Named rule templates: eleven of their own rules, three that put others together. ``template(name)`` resolves one."""

from __future__ import annotations

from functools import lru_cache

from .builtin import RULES
from .model import RuleSet, resolve_template, rule_dict


def _content(name: str, severity: str, pattern: str) -> dict:
    return {"name": name, "severity": severity, "match": {"type": "content", "mode": "regex", "pattern": pattern}}


#: Names, severities and expressions of the catalogue.
TEMPLATES: dict[str, dict] = {
    "aws_keys": {"rules": [
        _content("AWS 访问密钥 ID", "critical", r"AKIA[0-9A-Z]{16}"),
        _content("AWS 秘密密钥", "critical", r"(?i)aws.{0,20}secret.{0,20}[A-Za-z0-9/+=]{40}"),
    ]},
    "azure_keys": {"rules": [
        _content("Azure 连接字符串", "critical", r"(?i)DefaultEndpointsProtocol=https?;AccountName=[^;]+;AccountKey=[A-Za-z0-9+/=]+"),
        _content("Azure 账户密钥", "critical", r"(?i)azure.{0,20}(?:key|secret).{0,20}[A-Za-z0-9+/=]{88}"),
    ]},
    "gcp_keys": {"rules": [
        _content("GCP 服务账号私钥", "critical", r"(?i)private_key.{0,50}BEGIN PRIVATE KEY"),
        _content("GCP API 密钥", "critical", r"AIza[0-9A-Za-z_\-]{35}"),
    ]},
    "github_tokens": {"rules": [
        _content("GitHub PAT 令牌", "critical", r"\bghp_[A-Za-z0-9]{36}\b"),
        _content("GitHub OAuth 令牌", "critical", r"\bgho_[A-Za-z0-9]{36}\b"),
        _content("GitHub App 令牌", "critical", r"\bghs_[A-Za-z0-9]{36}\b"),
    ]},
    "slack_tokens": {"rules": [
        _content("Slack Bot 令牌", "critical", r"\bxoxb-[0-9]{10,13}-[0-9]{10,13}[A-Za-z0-9]*\b"),
        _content("Slack User 令牌", "critical", r"\bxoxp-[0-9]{10,13}-[0-9]{10,13}-[0-9]{10,13}[A-Za-z0-9]*\b"),
        _content("Slack Webhook URL", "warning", r"https://hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]+"),
    ]},
    "stripe_keys": {"rules": [
        _content("Stripe Secret 密钥", "critical", r"\bsk_live_[A-Za-z0-9]{24,}\b"),
        _content("Stripe Publishable 密钥", "warning", r"\bpk_live_[A-Za-z0-9]{24,}\b"),
        _content("Stripe Restricted 密钥", "critical", r"\brk_live_[A-Za-z0-9]{24,}\b"),
    ]},
    "jwt_tokens": {"rules": [_content("JWT 令牌", "critical", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b")]},
    "private_keys": {"rules": [
        _content("PEM 私钥文件头", "critical", r"-----BEGIN\s+(RSA\s+|EC\s+|DSA\s+|OPENSSH\s+|PGP\s+)?PRIVATE\s+KEY-----"),
        _content("PKCS#8 私钥文件头", "critical", r"-----BEGIN\s+ENCRYPTED\s+PRIVATE\s+KEY-----"),
    ]},
    "database_connection_strings": {"rules": [
        _content("MySQL 连接字符串", "critical", r"(?i)mysql://[^:\s]+:[^@\s]+@[A-Za-z0-9.:-]+"),
        _content("PostgreSQL 连接字符串", "critical", r"(?i)postgres(?:ql)?://[^:\s]+:[^@\s]+@[A-Za-z0-9.:-]+"),
        _content("MongoDB 连接字符串", "critical", r"(?i)mongodb(?:\+srv)?://[^:\s]+:[^@\s]+@[A-Za-z0-9.:-]+"),
        _content("Redis 连接字符串", "warning", r"(?i)redis://:[^@\s]+@[A-Za-z0-9.:-]+"),
    ]},
    "privacy_data": {"rules": [
        _content("身份证号", "warning", r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx]\b"),
        _content("手机号", "warning", r"\b1[3-9]\d{9}\b"),
        _content("邮箱地址", "info", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ]},
    "common_credentials": {"rules": [
        _content("密码赋值", "warning", r"""(?i)(?:password|passwd|pwd)\s*[:=]\s*['"]?[^'"\s]{4,}"""),
        _content("API 密钥赋值", "warning", r"""(?i)api[_-]?key\s*[:=]\s*['"]?[^'"\s]{8,}"""),
        _content("Token 赋值", "warning", r"""(?i)(?:token|secret|access_token)\s*[:=]\s*['"]?[^'"\s]{8,}"""),
    ]},
    "cloud_keys": {"extends": ["aws_keys", "azure_keys", "gcp_keys"]},
    "saas_tokens": {"extends": ["github_tokens", "slack_tokens", "stripe_keys", "jwt_tokens"]},
    "compliance_scan": {
        "extends": ["cloud_keys", "saas_tokens", "privacy_data", "common_credentials", "private_keys", "database_connection_strings"],
        "rules": [rule_dict(RULES[2]) | {"name": "敏感配置文件名"}],
    },
}


def names() -> list[str]:
    return list(TEMPLATES)


def metadata() -> list[dict]:
    """Of each template: name, parents, and how many rules it has with theirs."""
    return [{"name": n, "extends": list(TEMPLATES[n].get("extends", [])), "rules": len(template(n).rules)} for n in TEMPLATES]


@lru_cache(maxsize=None)
def template(name: str) -> RuleSet:
    return resolve_template(name, TEMPLATES)
