"""Explicit schemas of the input tables. Nothing is inferred from data."""

VISITS = "Patient string, Weeks int, FVC int, Percent double, Age int, Sex string, SmokingStatus string"

QC_SUMMARY = (
    "case string, status string, tech_checks int, tech_passed int, tech_failed int, volume_ml double, volume_tech_status string, "
    "branch_count int, branch_count_tech_status string, max_generation int, max_gen_tech_status string, pc_ratio double, "
    "pc_ratio_tech_status string, tapering_ratio double, tapering_tech_status string"
)

# Metric documents hold numbers that may have been written as text, so every number is
# read as text and cast (see readers.read_documents).
METRIC_BAG = {
    "total_volume_mm3": "double", "generation_coverage": "double", "central_volume_mm3": "double", "intermediate_volume_mm3": "double",
    "peripheral_volume_mm3": "double", "peripheral_to_central_ratio": "double", "central_branch_count": "long",
    "intermediate_branch_count": "long", "peripheral_branch_count": "long", "peripheral_volume_percent": "double",
    "mean_peripheral_diameter_mm": "double", "median_peripheral_diameter_mm": "double", "std_peripheral_diameter_mm": "double",
    "mean_peripheral_branch_volume_mm3": "double", "median_peripheral_branch_volume_mm3": "double", "peripheral_branch_density": "double",
    "mean_central_diameter_mm": "double", "central_to_peripheral_diameter_ratio": "double", "diameter_cv": "double",
    "diameter_mean_all": "double", "diameter_std_all": "double", "mean_tortuosity": "double", "median_tortuosity": "double",
    "std_tortuosity": "double", "mean_diameter_to_length_ratio": "double", "left_side_branch_count": "long",
    "right_side_branch_count": "long", "symmetry_index": "double",
}
PARENCHYMAL_BAG = {"mean_lung_density_HU": "double", "histogram_entropy": "double"}
