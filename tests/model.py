"""The lifecycle rules one call at a time, on plain dictionaries: the tests' oracle."""

from copy import deepcopy
from datetime import timedelta

from stallbook.functions import fixed_values as V

ADMIN = ("admin", "owner")


class Refused(Exception):
    pass


class Model:
    def __init__(self, now, packages, subscriptions, payments, providers, profiles, unique=False):
        self.now = now
        self.unique = unique  # one row per user, package and status
        self.packages = {p["id"]: p for p in packages}
        self.subs = {s["id"]: dict(s) for s in subscriptions}
        self.pays = {p["id"]: dict(p) for p in payments}
        self.places = {p["id"]: dict(p) for p in providers}
        self.roles = {u["id"]: u.get("role") for u in profiles}

    # -- helpers
    def admin(self, actor):
        if self.roles.get(actor) not in ADMIN:
            raise Refused(V.FORBIDDEN)

    def live(self, s):
        return s["status"] == "active" and (s["expires_at"] is None or s["expires_at"] > self.now)

    def call(self, name, *args):
        """A call as one transaction: one that is refused leaves nothing behind."""
        before = deepcopy((self.subs, self.pays, self.places, self.roles))
        try:
            return getattr(self, name)(*args)
        except Refused:
            self.subs, self.pays, self.places, self.roles = before
            raise

    def free(self, row):
        if self.unique and any(
                o is not row and all(o[c] == row[c] for c in ("user_id", "package_id", "status"))
                for o in self.subs.values()):
            raise Refused(V.DUPLICATE_STATUS)

    def change(self, s, note=None, **fields):
        if note is not None:
            s["notes"] = (s["notes"] + "\n" if s["notes"] is not None else "") + note
        s.update(fields, updated_at=self.now)
        if "status" in fields:
            self.free(s)

    # -- calls
    def activate(self, actor, sub_id, pay_id, new_pay):
        self.admin(actor)
        s = self.subs.get(sub_id)
        if s is None:
            raise Refused(V.SUBSCRIPTION_MISSING)
        if s["status"] != "pending":
            raise Refused(V.NOT_PENDING + s["status"])
        package = self.packages[s["package_id"]]
        if pay_id is not None:
            if pay_id not in self.pays:
                raise Refused(V.ACTIVATION_PAYMENT_MISSING)
        else:
            pay_id = new_pay
            self.pays[pay_id] = {"id": pay_id, "user_id": s["user_id"], "package_id": s["package_id"],
                                 "amount": s["amount"]}
        days = 30 if package["duration_days"] is None else package["duration_days"]
        self.change(s, status="active", payment_id=pay_id, started_at=self.now,
                    expires_at=self.now + timedelta(days=days))
        self.pays[pay_id].update(status="completed", completed_at=self.now)
        mine = [o for o in self.subs.values() if o["user_id"] == s["user_id"] and o is not s]
        for o in mine:
            if o["status"] == "pending" and o["package_id"] == s["package_id"]:
                self.change(o, V.NOTE_OTHER_ACTIVATED, status="cancelled")
            elif self.live(o):
                self.change(o, V.NOTE_NEW_PACKAGE % package["name"], status="cancelled",
                            expires_at=self.now)
        places = [p for p in self.places.values() if p["user_id"] == s["user_id"]]
        limit = 1 if package["max_places"] is None else package["max_places"]
        off = 0
        if len(places) > limit:
            active = sorted((p for p in places if p["status"] == "active"),
                            key=lambda p: (p["created_at"] is None, p["created_at"], p["id"]))
            for p in active[:len(places) - limit]:
                p.update(status="pending", updated_at=self.now)
                off += 1
            self.change(s, V.NOTE_PLACES_SWITCHED_OFF % (off, limit, len(places)))
        return {"payment_id": pay_id, "places_deactivated": off}

    def create(self, actor, package_id, new_id):
        if actor is None:
            raise Refused(V.SIGN_IN_FIRST)
        package = self.packages.get(package_id)
        if package is None:
            raise Refused(V.PACKAGE_MISSING)
        if not package["is_active"]:
            raise Refused(V.PACKAGE_INACTIVE)
        mine = [s for s in self.subs.values() if s["user_id"] == actor]
        if any(s["status"] == "pending" and s["package_id"] == package_id for s in mine):
            raise Refused(V.ALREADY_PENDING)
        self.roles.setdefault(actor, "user")
        for s in mine:
            if s["status"] == "pending":
                self.change(s, V.NOTE_REPLACED_REQUEST, status="cancelled")
        live = any(self.live(s) for s in mine)
        active = sum(p["user_id"] == actor and p["status"] == "active" for p in self.places.values())
        limit = 1 if package["max_places"] is None else package["max_places"]
        self.subs[new_id] = {
            "id": new_id, "user_id": actor, "package_id": package_id, "status": "pending",
            "started_at": None, "expires_at": None, "payment_id": None, "amount": package["price"],
            "auto_renew": False, "notes": None, "created_at": self.now, "updated_at": self.now}
        self.free(self.subs[new_id])
        return {"subscription_id": new_id, "has_active_subscription": live,
                "excess": max(0, active - limit)}

    def cancel(self, actor, sub_id, reason):
        self.admin(actor)
        s = self.subs.get(sub_id)
        if s is None:
            raise Refused(V.SUBSCRIPTION_MISSING)
        if s["status"] not in ("pending", "active"):
            raise Refused(V.CANNOT_CANCEL + s["status"])
        note = V.NOTE_CANCELLED_BY_ADMIN if reason is None else V.NOTE_CANCEL_REASON + reason
        self.change(s, note, status="cancelled")
        if s["payment_id"] in self.pays:
            self.pays[s["payment_id"]]["status"] = "cancelled"
        return {}

    def expire(self):
        gone = [s for s in self.subs.values() if s["status"] == "active"
                and s["expires_at"] is not None and s["expires_at"] < self.now]
        for s in gone:
            self.change(s, status="expired")
        return {"expired": len(gone)}

    def link(self, sub_id, pay_id):
        s, p = self.subs.get(sub_id), self.pays.get(pay_id)
        if s is None:
            raise Refused(V.SUBSCRIPTION_MISSING)
        if p is None:
            raise Refused(V.PAYMENT_MISSING)
        if p["status"] is not None and p["status"] != "completed":
            raise Refused(V.PAYMENT_NOT_COMPLETED + p["status"])
        if p["user_id"] is not None and p["user_id"] != s["user_id"]:
            raise Refused(V.USER_MISMATCH)
        self.change(s, payment_id=pay_id)
        return {}
