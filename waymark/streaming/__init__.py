"""No streaming operator belongs to the supported set: profiles and checks are batch queries."""
