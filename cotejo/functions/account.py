"""Scalar rules for keys, scopes, e-mails, plans, usage and invoices. Time is always an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Formats of keys, scopes and e-mail addresses.
KEY_PATTERN = "^vfy_[A-Za-z0-9_-]{64}$"
SCOPE_PATTERN = "^[a-z][a-z_]*[a-z]:[a-z][a-z_]*[a-z]$|^[a-z]:[a-z]$"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# Throw-away mail providers that registration refuses.
DISPOSABLE_DOMAINS = (
    "tempmail.com", "throwaway.email", "guerrillamail.com", "10minutemail.com", "mailinator.com",
    "trashmail.com", "fakeinbox.com", "yopmail.com", "temp-mail.org",
)


# --- money and quotas -------------------------------------------------------------------------------------------
def billable_amount(cost: Column, markup: Column) -> Column:
    factor = F.lit(1).cast("decimal(5,2)") + markup / F.lit(100).cast("decimal(3,0)")
    return F.coalesce((cost * factor).cast("decimal(12,6)"), F.lit(0).cast("decimal(12,6)"))


def limit_exceeded(count: Column, limit: Column) -> Column:
    return F.coalesce(count >= limit, F.lit(False))


def remaining_quota(count: Column, limit: Column) -> Column:
    return F.when(limit.isNull(), F.lit(-1).cast("bigint")).otherwise(
        F.greatest(F.lit(0).cast("bigint"), limit - count)
    )


def is_paid(paid_at: Column) -> Column:
    return paid_at.isNotNull()


def is_overdue(paid_at: Column, due_at: Column, as_of: Column) -> Column:
    return F.coalesce(paid_at.isNull() & (due_at < as_of), F.lit(False))


def subscription_active(period_end: Column, cancelled_at: Column, as_of: Column) -> Column:
    return F.coalesce((period_end >= as_of) & cancelled_at.isNull(), F.lit(False))


def is_trial(trial_ends_at: Column, as_of: Column) -> Column:
    return F.coalesce(trial_ends_at >= as_of, F.lit(False))


def annual_discount_pct(monthly: Column, annual: Column) -> Column:
    yearly = (monthly * 12).cast("decimal(12,2)")
    pct = (((yearly - annual) * 100) / yearly).cast("decimal(9,4)")
    priced = (monthly != 0) & (annual != 0)
    return F.when(priced, pct).otherwise(F.lit(0).cast("decimal(9,4)"))


# --- keys ---------------------------------------------------------------------------------------------------------
def key_valid(is_active: Column, revoked_at: Column, expires_at: Column, as_of: Column) -> Column:
    """Active, not revoked, and not yet expired; a key expiring exactly at ``as_of`` is expired."""
    return is_active & revoked_at.isNull() & (expires_at.isNull() | (expires_at > as_of))


def expires_at(created_at: Column, days: Column) -> Column:
    """NULL days never expire; a non-positive number of days is invalid and gives NULL."""
    return F.when(days > 0, created_at + F.make_interval(days=days))


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def key_prefix(key: Column) -> Column:
    return F.substring(key, 1, 12)


def is_key_format(key: Column) -> Column:
    return F.coalesce(key.rlike(KEY_PATTERN), F.lit(False))


def is_hash_format(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def revoke(as_of: Column) -> dict[str, Column]:
    return {"is_active": F.lit(False), "revoked_at": as_of}


def record_usage(as_of: Column) -> dict[str, Column]:
    return {"last_used_at": as_of}


def record_login(as_of: Column) -> dict[str, Column]:
    return {"last_login_at": as_of, "updated_at": as_of}


def set_active(active: bool, as_of: Column) -> dict[str, Column]:
    return {"is_active": F.lit(active), "updated_at": as_of}


def verify_email(as_of: Column) -> dict[str, Column]:
    return {"email_verified": F.lit(True), "updated_at": as_of}


def can_authenticate(is_active: Column, is_verified: Column) -> Column:
    return is_active & is_verified


# --- scopes -------------------------------------------------------------------------------------------------------
def normalize_scope(code: Column) -> Column:
    """Lower-case ``category:action``, or NULL when the code is malformed."""
    c = F.lower(F.trim(code))
    return F.when(c.rlike(SCOPE_PATTERN), c)


def scope_category(code: Column) -> Column:
    return F.split_part(code, F.lit(":"), F.lit(1))


def scope_action(code: Column) -> Column:
    return F.split_part(code, F.lit(":"), F.lit(2))


def scope_satisfies(held: Column, required: Column) -> Column:
    """Equal, ``admin:all``, or ``<category>:all`` of the required category."""
    return (
        (held == required) | (held == "admin:all")
        | (held == F.concat(scope_category(required), F.lit(":all")))
    )


# --- e-mail -------------------------------------------------------------------------------------------------------
def clean_email(email: Column) -> Column:
    e = F.lower(F.trim(email))
    return F.when(e.rlike(EMAIL_PATTERN) & F.length(e).between(5, 255), e)


def strict_email_reasons(email: Column, disposable: Column | None = None) -> Column:
    """Names of every rule the address breaks, in checking order; empty when it is acceptable.

    Rules about the local part or the domain apply only when there is exactly one ``@``. ``disposable`` lets a caller
    pass a flag joined from a longer provider list."""
    e = F.lower(F.trim(email))
    ats = F.length(e) - F.length(F.replace(e, F.lit("@"), F.lit("")))
    local, domain = F.split_part(e, F.lit("@"), F.lit(1)), F.split_part(e, F.lit("@"), F.lit(2))
    tld = F.split_part(domain, F.lit("."), F.lit(-1))
    dotted = F.contains(domain, F.lit("."))
    split = ats == 1
    thrown_away = domain.isin(*DISPOSABLE_DOMAINS) if disposable is None else disposable
    rules = [
        ("spaces", F.contains(e, F.lit(" "))),
        ("consecutive_dots", F.contains(e, F.lit(".."))),
        ("no_at", ats == 0),
        ("many_at", ats > 1),
        ("local_empty", split & (local == "")),
        ("local_too_long", split & (F.length(local) > 64)),
        ("local_charset", split & ~local.rlike("^[a-z0-9._+-]+$")),
        ("local_edge_dot", split & local.rlike(r"^\.|\.$")),
        ("domain_too_short", split & (F.length(domain) < 3)),
        ("domain_charset", split & ~domain.rlike("^[a-z0-9.-]+$")),
        ("no_tld", split & ~dotted),
        ("tld_too_short", split & dotted & (F.length(tld) < 2)),
        ("tld_not_letters", split & dotted & ~tld.rlike("^[a-z]+$")),
        ("disposable", split & thrown_away),
        ("domain_edge_hyphen", split & domain.rlike("^-|-$")),
        ("domain_edge_dot", split & domain.rlike(r"^\.|\.$")),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


# --- decisions ----------------------------------------------------------------------------------------------------
def decision_flags(status: Column, action: Column) -> dict[str, Column]:
    return {
        "is_valid": status == "OK",
        "requires_user_action": action.isin("REQUIRE_VALIDATION", "ALERT_NOT_FOUND"),
        "can_auto_save": action == "AUTO_SAVE",
    }


def match_summary(matches: Column) -> Column:
    """One line per compared field: mark, field, value, percent. ``matches`` is an array of
    ``struct<field_name, match, similarity, compared>``."""
    lines = F.transform(
        matches,
        lambda m: F.format_string(
            "%s %s: %s (%.0f%%)", F.when(m["match"], "✓").otherwise("✗"), m["field_name"], m["compared"],
            F.bround(m["similarity"] * 100.0, 0)
        ),
    )
    return F.when(F.coalesce(F.size(matches), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(
        F.lit("Sin comparaciones disponibles")
    )
