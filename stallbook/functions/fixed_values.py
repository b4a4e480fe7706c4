"""Values that must equal the marketplace's own for right results.

Texts users see or that are stored in notes, status sets, defaults and limits.
Operators take them from here only.
"""

# --- fixed values: table names of the overview -------------------------------
OVERVIEW_TABLES = (
    "activities", "ads", "ads_images", "ads_videos", "affiliates", "areas", "branches",
    "cities", "commissions", "dashboard_stats", "discount_codes", "favorites",
    "interactions", "malls", "offers", "packages", "payments", "price_history",
    "products", "providers", "reports", "reviews", "services", "user_profiles", "visits",
)

# --- fixed values: status sets and roles -------------------------------------
SUBSCRIPTION_STATUSES = ("pending", "active", "expired", "cancelled", "suspended")
PAYMENT_STATUSES = (
    "pending", "paid", "completed", "failed", "cancelled", "success", "confirmed", "processing",
)
PAYMENT_STATUSES_OLD = (
    "pending", "paid", "completed", "failed", "cancelled", "success", "confirmed",
)
ADMIN_ROLES = ("admin", "owner")
ROLE_EDITOR = "admin"
DEFAULT_ROLE = "user"

# --- fixed values: numeric defaults and limits -------------------------------
FREE_TIER = "free"
UNNAMED_TIER = "custom"
FREE_PLACES = 1
RECENCY_DAYS = 30
DURATION_DEFAULT_PAYMENTS = 0
DURATION_DEFAULT_ACTIVATION = 30
LISTING_LIMIT = 50
FALLBACK_LIMIT = 12
SEARCH_LIMIT = 200
SUBSCRIPTIONS_LIMIT = 100
PREVIEW_LIMIT = 100
PREVIEW_MAX = 500
HOME_PROVIDERS, HOME_SERVICES, HOME_ADS = 10, 6, 6
FORM_PRICE, FORM_DURATION, FORM_MAX_PLACES, FORM_WEIGHT = 0, 30, 1, 0

# --- fixed values: default packages ------------------------------------------
# name, price, duration_days, max_places, priority_weight, is_active, description
DEFAULT_PACKAGES = (
    ("الباقة الأساسية", "100.00", 30, 3, 1, True,
     "باقة مناسبة للمبتدئين - تسمح بإضافة حتى 3 أماكن"),
    ("الباقة المتوسطة", "250.00", 30, 10, 2, True,
     "باقة متوسطة - تسمح بإضافة حتى 10 أماكن مع أولوية أعلى"),
    ("الباقة المميزة", "500.00", 30, 50, 3, True,
     "باقة مميزة - تسمح بإضافة حتى 50 مكان مع أولوية عالية جداً"),
)

# --- fixed values: names and place types -------------------------------------
NEW_USER = "مستخدم جديد"
UNKNOWN_USER = "مستخدم غير معروف"
ONLINE_PLACE = "اون لاين"
PHYSICAL_PLACE = "place"

# --- fixed values: display texts of a status ---------------------------------
STATUS_TEXTS = {
    "pending": "⏳ في انتظار التفعيل",
    "active": "✅ نشط",
    "expired": "⏰ منتهي",
    "cancelled": "❌ ملغي",
    "suspended": "⏸️ معلق",
    "completed": "✅ مفعّل",
    "failed": "⚠️ فاشل",
}

# --- fixed values: errors ------------------------------------------------------
FORBIDDEN = "forbidden: admin only"
SIGN_IN_FIRST = "يجب تسجيل الدخول أولاً"
PACKAGE_MISSING = "الباقة المحددة غير موجودة"
PACKAGE_INACTIVE = "الباقة المحددة غير نشطة"
ALREADY_PENDING = "لديك اشتراك معلق بالفعل في هذه الباقة"
DUPLICATE_STATUS = 'duplicate key value violates unique constraint "subscriptions_user_package_unique"'
SUBSCRIPTION_MISSING = "الاشتراك غير موجود"
NOT_PENDING = "الاشتراك ليس في حالة انتظار. الحالة الحالية: "
ACTIVATION_PAYMENT_MISSING = "دفعة غير موجودة"
PAYMENT_MISSING = "الدفعة غير موجودة"
PAYMENT_NOT_COMPLETED = "الدفعة ليست مكتملة. الحالة: "
USER_MISMATCH = "الاشتراك والدفعة ليسا لنفس المستخدم"
CANNOT_CANCEL = "لا يمكن إلغاء اشتراك بهذه الحالة. الحالة الحالية: "
CANNOT_CANCEL_PAYMENT = "لا يمكن إلغاء اشتراك غير معلق. الحالة الحالية: "
UNKNOWN_PACKAGE_ID = "unknown package id "
QUOTA_EXCEEDED = "quota exceeded (%s/%s places) for tier %s"

# --- fixed values: notes -------------------------------------------------------
NOTE_REPLACED_REQUEST = "تم الإلغاء تلقائياً عند إنشاء طلب اشتراك جديد في باقة أخرى."
NOTE_OTHER_ACTIVATED = "تم الإلغاء تلقائياً عند تفعيل اشتراك آخر."
NOTE_NEW_PACKAGE = "تم الإلغاء تلقائياً عند تفعيل باقة جديدة (%s)."
NOTE_PLACES_SWITCHED_OFF = (
    "⚠️ تنبيه: تم تعطيل %s مكان تلقائياً لأن الباقة الجديدة تسمح بـ %s أماكن فقط،"
    " وكان لديه %s أماكن نشطة."
)
NOTE_CANCEL_REASON = "سبب الإلغاء: "
NOTE_CANCELLED_BY_ADMIN = "تم الإلغاء من قبل المدير"

# --- fixed values: result messages ---------------------------------------------
ACTIVATED = "تم تفعيل الاشتراك بنجاح."
ACTIVATED_PAYMENT = "تم تفعيل الاشتراك بنجاح"
WARN_PLACES_SWITCHED_OFF = (
    " تم تعطيل %s مكان تلقائياً (كان لديه %s أماكن والباقة الجديدة تسمح بـ %s فقط)."
)
CREATED = "تم إنشاء طلب الاشتراك بنجاح. يرجى الدفع ثم انتظار التفعيل من الإدارة."
CREATED_OVER_QUOTA = (
    "تم إنشاء طلب الاشتراك بنجاح. ⚠️ تحذير: لديك %s أماكن نشطة حالياً، والباقة الجديدة (%s)"
    " تسمح بـ %s أماكن فقط. سيتم تعطيل %s مكان تلقائياً عند التفعيل (الأقدم أولاً)."
)
CREATED_HAS_ACTIVE = (
    "تم إنشاء طلب الاشتراك بنجاح. لديك باقة نشطة حالياً (%s)."
    " عند التفعيل، سيتم تقييم الباقة الجديدة."
)
ACTIVE_PACKAGE = "باقة نشطة"
EXCESS_WARNING = "سيتم تعطيل %s مكان تلقائياً عند التفعيل"
CANCELLED = "تم إلغاء الاشتراك بنجاح"
LINKED = "تم ربط الدفعة بالاشتراك بنجاح"
PAYMENT_INFO_ONLY = (
    'هذه معلومات دفع فقط. لن يتم إنشاء اشتراك إلا بعد الضغط على "اشترك الآن"'
    " ثم إتمام الدفع. بعد الدفع، سيتم التفعيل بواسطة الإدارة."
)
