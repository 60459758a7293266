"""Physical constants and fixed axes (fixed values, SI unless noted)."""

EARTH_RADIUS = 6.371e6        # m
EARTH_RADIUS_KM = 6371.0
GRAVITY = 9.80665
OMEGA = 7.2921e-5             # rad/s
R_DRY = 287.04
CP = 1004.0
KAPPA = 0.2854                # potential temperature, N^2, EP flux
KAPPA_ENERGY = R_DRY / CP     # energy cycle only
LATENT_HEAT = 2.501e6
DAY_SECONDS = 86400.0
AXIAL_TILT_DEG = 23.4
MS_TO_KNOTS = 1.94384
P_SURFACE_HPA = 1000.0

PRESSURE_LEVELS = (10, 50, 100, 150, 200, 250, 300, 500, 700, 850, 925, 1000)
THETA_LEVELS = (280, 300, 315, 330, 350, 400, 500, 700)

MISSING_CODE = 65535          # quantized "no data"
QUANT_STEPS = 65534
SENTINELS = (-99.9, -999.0, -9.9)
SENTINEL_TOLERANCE = 0.05
POLE_COS = 1e-3               # below this cos(lat) a row counts as a pole
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
