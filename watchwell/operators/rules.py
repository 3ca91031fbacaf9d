"""Parameters of the detection rules."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Rule:
    """One rule: its window, thresholds and points."""

    rule_id: str
    name: str
    window_minutes: int
    minimum: int
    cooldown_minutes: int
    base_risk: int
    enabled: bool = True
    minimum_users: int = 0
    bonus: int = 0
    critical: int | None = None
    critical_users: int | None = None
    intense_bonus: int = 0
    reason_disabled: str = ""


# Rule ids, names, defaults and the texts of alerts.
BRUTE_FORCE = Rule("AUTH_BRUTE_FORCE_USER", "Múltiples fallos contra un usuario", 10, 6, 15, 65, critical=20, intense_bonus=20)
SPRAY = Rule("AUTH_PASSWORD_SPRAY_IP", "Una IP intentando acceder a varias cuentas", 10, 6, 15, 65, minimum_users=3, bonus=5, critical=20, critical_users=10, intense_bonus=20)
SUCCESS_AFTER = Rule("AUTH_SUCCESS_AFTER_FAILURES", "Éxito después de múltiples fallos", 10, 5, 15, 75, bonus=5, critical=10, intense_bonus=10)
LOCKOUT = Rule("AUTH_ACCOUNT_LOCKOUT", "Bloqueos múltiples de cuenta", 10, 2, 1440, 85)
NEW_IP = Rule("AUTH_NEW_IP_FOR_USER", "IP nueva para el usuario", 10, 3, 1440, 40)

# Fixed values: (description, description if authorized, recommendation).
TEXTS = {
    "AUTH_BRUTE_FORCE_USER": (
        "El usuario superó el umbral de fallos dentro de la ventana.",
        "Una cuenta autorizada superó el umbral anómalo de fallos en la ventana.",
        "Validar el origen y confirmar actividad con el responsable de la cuenta.",
    ),
    "AUTH_PASSWORD_SPRAY_IP": (
        "La IP produjo fallos contra varias cuentas en la ventana.",
        "Una IP autorizada superó el umbral anómalo contra varias cuentas.",
        "Descartar primero NAT, proxy o infraestructura compartida autorizada.",
    ),
    "AUTH_SUCCESS_AFTER_FAILURES": (
        "Se observó un éxito después de varios fallos recientes del usuario.",
        "Se observó un éxito después de varios fallos recientes del usuario.",
        "Priorizar la revisión del origen y validar el acceso con el usuario.",
    ),
    "AUTH_ACCOUNT_LOCKOUT": (
        "ADFS registró múltiples bloqueos de la misma cuenta en la ventana.",
        "Una cuenta autorizada superó el umbral anómalo de bloqueos.",
        "Revisar intentos previos y confirmar si los bloqueos fueron esperados.",
    ),
    "AUTH_NEW_IP_FOR_USER": (
        "Una IP nueva repitió actividad fuera de la línea base del usuario.",
        "Una IP autorizada nueva superó el umbral anómalo de actividad.",
        "Validar si el origen es legítimo antes de clasificar la señal.",
    ),
}

DISABLED = ("after_hours", "unusual_hour_for_user", "unauthorized_network", "new_application_for_user", "global_failure_spike", "authentication_pattern_change", "repeated_lockout")


@dataclass(frozen=True)
class Exclusions:
    """Authorized keys and the raised thresholds that hold for them."""

    user_keys: tuple[str, ...] = ()
    client_ip_keys: tuple[str, ...] = ()
    relying_parties: tuple[str, ...] = ()
    thresholds: dict[str, int] = field(default_factory=dict)

    def threshold(self, name: str, default: int) -> int:
        return max(default, self.thresholds.get(name, default))


@dataclass(frozen=True)
class RuleSet:
    brute_force: Rule = BRUTE_FORCE
    spray: Rule = SPRAY
    success_after: Rule = SUCCESS_AFTER
    lockout: Rule = LOCKOUT
    new_ip: Rule = NEW_IP
    severities: tuple[tuple[str, int], ...] = (("critical", 85), ("high", 65), ("medium", 40), ("low", 0))
    bonus_per_event: int = 1
    max_bonus: int = 10
    zone: str = "America/Guayaquil"

    def all(self) -> tuple[Rule, ...]:
        return (self.brute_force, self.spray, self.success_after, self.lockout, self.new_ip)

    def longest_window(self) -> int:
        return max(r.window_minutes for r in self.all() if r.enabled)


def slow_rules(window_minutes: int = 1440) -> RuleSet:
    """Rules for sparse activity, with day-long windows."""
    d = RuleSet()
    return replace(
        d,
        brute_force=replace(d.brute_force, window_minutes=window_minutes),
        spray=replace(d.spray, window_minutes=window_minutes, minimum=4),
        success_after=replace(d.success_after, window_minutes=window_minutes, minimum=4),
        lockout=replace(d.lockout, window_minutes=window_minutes, minimum=6),
        new_ip=replace(d.new_ip, window_minutes=window_minutes),
    )
