"""Names, codes and column layouts that the whole engine shares."""

from __future__ import annotations

BAND_ORDER = ("B02", "B03", "B04", "B08")
ROLES = ("before", "after")
DN_SCALE = 10_000.0
NO_CHANGE_DATA = 255
RESOLUTION_M = 10.0

# The scene classification codes of the Sentinel-2 L2A product and their names.
CLASS_NAMES = {
    0: "no_data",
    1: "saturated_or_defective",
    2: "dark_area_or_cast_shadow",
    3: "cloud_shadow",
    4: "vegetation",
    5: "not_vegetated",
    6: "water",
    7: "unclassified",
    8: "cloud_medium_probability",
    9: "cloud_high_probability",
    10: "thin_cirrus",
    11: "snow_or_ice",
}
STRICT = (4, 5, 6)
LENIENT = (4, 5, 6, 7)
POLICIES = {"strict": STRICT, "lenient": LENIENT}

# The groups in which masked classes are reported.
MASK_REASONS = {
    "no_data": (0,),
    "saturated_or_defective": (1,),
    "shadow": (2, 3),
    "unclassified": (7,),
    "cloud": (8, 9),
    "cirrus": (10,),
    "snow_or_ice": (11,),
}

# The feature vector's names in order, and how each reads in a report.
FEATURE_DESCRIPTIONS = {
    "changed_area_ha": "Total changed area (hectares)",
    "change_fraction_of_valid": "Fraction of observation area with detected change",
    "ndvi_before_mean": "Baseline pre-change vegetation index (NDVI)",
    "ndvi_after_mean": "Post-change vegetation index (NDVI)",
    "ndvi_diff_mean": "Mean landscape NDVI difference",
    "change_ndvi_before_mean": "Pre-change NDVI within change zones",
    "change_ndvi_after_mean": "Post-change NDVI within change zones",
    "change_ndvi_diff_mean": "Mean NDVI drop in change zones",
    "change_ndvi_diff_std": "NDVI variance in change zones",
    "veg_loss_ha_01": "Vegetation loss area (ΔNDVI ≤ -0.1)",
    "veg_loss_ha_02": "Severe vegetation loss area (ΔNDVI ≤ -0.2)",
    "veg_loss_ha_03": "Extreme vegetation destruction area (ΔNDVI ≤ -0.3)",
    "veg_gain_ha_02": "Vegetation regrowth / greening area (ΔNDVI ≥ +0.2)",
    "veg_loss_fraction": "Fraction of AOI undergoing severe vegetation loss",
    "patch_count": "Number of distinct change clusters / patches",
    "mean_patch_area_ha": "Mean change cluster area (hectares)",
    "max_patch_area_ha": "Largest change cluster area (hectares)",
    "patch_density_per_km2": "Change cluster density per km²",
    "large_patch_count": "Count of critical change clusters ≥ 1.0 ha",
    "delta_b02_mean": "Blue band reflectance shift in change zones",
    "delta_b03_mean": "Green band reflectance shift in change zones",
    "delta_b04_mean": "Red band reflectance shift (soil exposure indicator)",
    "delta_b08_mean": "NIR band reflectance shift (biomass loss indicator)",
    "brightness_diff_mean": "Visible spectrum brightness difference",
    "scl_veg_loss_ha": "SCL categorical vegetation loss (hectares)",
}
FEATURE_NAMES = tuple(FEATURE_DESCRIPTIONS)
PRIORITIES = ("LOW", "MEDIUM", "HIGH")

PIXELS_LONG = "scene_id long, role string, band string, row int, col int, dn int"
BAND_META = "scene_id long, role string, band string, crs string, a double, b double, c double, d double, e double, f double, width int, height int, nodata int"
