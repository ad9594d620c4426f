"""tidewire.streaming"""
